"""Registered queries: every operator applied to the driver's tables, and its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from missive.functions import labels, mime, phone, text, vcard
from missive.operators import analytics, control, custody, export, normalize, postings, reads, search, store
from missive.operators.timeline import Timeline
from missive.session import shared_folder
from missive.sources import backup, ranges
from missive.sources.events import DAYS_SQL, MESSAGES_SQL, messages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ADDRESS = "+10000000042"
START, END = 1_704_240_000, 1_706_745_600
WITH = f"WITH messages AS ({MESSAGES_SQL})"
WITH_DAYS = f"WITH messages AS ({DAYS_SQL})"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------ conversations

_LAST = """CASE WHEN l.record_type = 3 AND l.type = 1 THEN 'Incoming call' WHEN l.record_type = 3 AND l.type = 2 THEN 'Outgoing call'
  WHEN l.record_type = 3 AND l.type = 3 THEN 'Missed call' WHEN l.record_type = 3 AND l.type = 4 THEN 'Voicemail'
  WHEN l.record_type = 3 AND l.type = 5 THEN 'Rejected call' WHEN l.record_type = 3 AND l.type = 6 THEN 'Refused call' ELSE coalesce(l.body, '') END"""


def _conversations_sql(where: str = "TRUE", rest: str = "") -> str:
    return f"""{WITH_DAYS}, m AS (SELECT * FROM messages WHERE {where}),
a AS (SELECT address, max(coalesce(contact_name, '')) AS contact_name, max(CASE WHEN subject <> '' THEN subject END) AS subject, max(date) AS last_date, count(*) AS message_count FROM m GROUP BY address)
SELECT a.address, a.contact_name, coalesce(a.subject, '') AS subject, {_LAST} AS last_message, a.last_date, a.message_count
FROM a LEFT JOIN m l ON l.address = a.address AND l.date = a.last_date {rest}"""


@query(_conversations_sql())
def conversations(spark, sf_dir):
    return reads.conversations(messages(spark, sf_dir, days=True))


@query(_conversations_sql())
def conversations_window(spark, sf_dir):
    return reads.conversations_window(messages(spark, sf_dir, days=True))


@query(_conversations_sql(f"date >= {START} AND date <= {END}"))
def conversations_range(spark, sf_dir):
    return reads.conversations(messages(spark, sf_dir, days=True), START, END)


@query(_conversations_sql(rest="QUALIFY row_number() OVER (PARTITION BY a.address ORDER BY l.id) = 1"))
def conversations_dedupe(spark, sf_dir):
    return reads.conversations(messages(spark, sf_dir, days=True), dedupe=True)


@query(_conversations_sql(rest="WHERE contains(lower(a.contact_name), 'tact 1') OR contains(lower(a.address), 'tact 1')"))
def conversation_filter(spark, sf_dir):
    return reads.matching(reads.conversations(messages(spark, sf_dir, days=True)), "TACT 1")


# ------------------------------------------------------------ threads and pages

_ROW = "id, record_type, address, coalesce(body, '') AS body, type, date, coalesce(duration, 0) AS duration"
_COLUMNS = ["id", "record_type", "address", "body", "type", "date", "duration"]


def _listed(rows: DataFrame) -> DataFrame:
    shown = rows.select(*_COLUMNS)
    return reads.filled(shown)


@query(f"{WITH} SELECT {_ROW} FROM messages WHERE address = '{ADDRESS}' AND record_type IN (1, 2)")
def thread_messages(spark, sf_dir):
    return _listed(reads.thread_messages(messages(spark, sf_dir), ADDRESS))


@query(f"{WITH} SELECT {_ROW} FROM messages WHERE address = '{ADDRESS}' AND record_type = 3")
def thread_calls(spark, sf_dir):
    return _listed(reads.thread_calls(messages(spark, sf_dir), ADDRESS))


@query(f"{WITH} SELECT {_ROW} FROM messages WHERE address = '{ADDRESS}' ORDER BY date, id LIMIT 20 OFFSET 5")
def thread_mixed(spark, sf_dir):
    return _listed(reads.thread(messages(spark, sf_dir), ADDRESS, 20, 5)[0])


@query(f"{WITH}, p AS (SELECT * FROM messages WHERE address = '{ADDRESS}' ORDER BY date, id LIMIT 20 OFFSET 5) SELECT {_ROW} FROM p WHERE record_type <> 3")
def thread_hide_calls(spark, sf_dir):
    return _listed(reads.thread(messages(spark, sf_dir), ADDRESS, 20, 5, show_calls=False)[0])


@query(f"{WITH} SELECT count(*) AS total FROM messages WHERE address = '{ADDRESS}'")
def thread_total(spark, sf_dir):
    return reads.thread(messages(spark, sf_dir), ADDRESS, 20, 5)[1]


@query(
    f"""{WITH} SELECT id, CASE WHEN record_type = 3 THEN 'call' ELSE 'message' END AS kind, date, address, coalesce(contact_name, '') AS contact_name,
coalesce(CASE WHEN record_type <> 3 THEN body END, '') AS body, coalesce(CASE WHEN record_type = 3 THEN duration END, 0) AS duration FROM messages WHERE date >= {START} AND date <= {END} ORDER BY date, id LIMIT 50 OFFSET 100"""
)
def activity_page(spark, sf_dir):
    rows = reads.activity(messages(spark, sf_dir), start=START, end=END, offset=100)
    return rows.select("id", "kind", "date", "address", "contact_name", F.coalesce("message.body", F.lit("")).alias("body"), F.coalesce("call.duration", F.lit(0)).alias("duration"))


@query(f"{WITH} SELECT {_ROW} FROM messages WHERE record_type = 3 ORDER BY date, id LIMIT 50 OFFSET 50")
def calls_page(spark, sf_dir):
    return _listed(reads.calls(messages(spark, sf_dir), offset=50))


@query(f"{WITH} SELECT {_ROW} FROM messages WHERE record_type = 3")
def calls_unlimited(spark, sf_dir):
    return _listed(reads.calls(messages(spark, sf_dir), limit=-1))


@query(f"{WITH} SELECT {_ROW} FROM messages WHERE address = '{ADDRESS}' ORDER BY date DESC, id DESC LIMIT 15")
def last_page(spark, sf_dir):
    return _listed(reads.last_page(messages(spark, sf_dir), ADDRESS, 15))


@query(f"{WITH} SELECT count(*) AS total FROM messages WHERE date >= {START} AND date <= {END}")
def activity_count(spark, sf_dir):
    return reads.activity_count(messages(spark, sf_dir), start=START, end=END)


@query(f"{WITH} SELECT min(date) AS first_date, max(date) AS last_date FROM messages")
def date_range(spark, sf_dir):
    return reads.date_range(messages(spark, sf_dir))


@query(f"{WITH} SELECT id, address, date, media_type FROM messages WHERE record_type IN (1, 2) AND (lower(media_type) LIKE 'image/%' OR lower(media_type) LIKE 'video/%')")
def media_items(spark, sf_dir):
    return reads.media_items(messages(spark, sf_dir)).select("id", "address", "date", "media_type")


@query(
    f"""{WITH} SELECT arg_min(contact_name, (date, id)) FILTER (contact_name <> '') AS contact_name, arg_min(subject, (date, id)) FILTER (subject <> '') AS subject,
count(*) FILTER (media_type <> '') AS media_count FROM messages WHERE address = '{ADDRESS}'"""
)
def thread_heading(spark, sf_dir):
    return reads.first_names(reads.of_address(messages(spark, sf_dir), ADDRESS))


# ------------------------------------------------------------ analytics

_SUMMARY = """count(*) AS total_messages, count(*) FILTER (record_type = 1) AS total_sms, count(*) FILTER (record_type = 2) AS total_mms, count(*) FILTER (record_type = 3) AS total_calls,
count(*) FILTER (record_type IN (1, 2) AND type = 2) AS total_sent, count(*) FILTER (record_type IN (1, 2) AND type = 1) AS total_received,
count(*) FILTER (record_type = 3 AND type = 1) AS incoming_calls, count(*) FILTER (record_type = 3 AND type = 2) AS outgoing_calls, count(*) FILTER (record_type = 3 AND type = 3) AS missed_calls,
CAST(coalesce(sum(duration) FILTER (record_type = 3), 0) AS BIGINT) AS total_call_duration, coalesce(avg(length(body)) FILTER (record_type IN (1, 2) AND body <> ''), 0.0) AS avg_message_length"""


@query(f"{WITH} SELECT {_SUMMARY} FROM messages")
def summary_stats(spark, sf_dir):
    return analytics.summary(messages(spark, sf_dir))


@query(f"{WITH} SELECT {_SUMMARY} FROM messages WHERE date < 0")
def summary_empty(spark, sf_dir):
    return analytics.summary(reads.between(messages(spark, sf_dir), end=-1))


@query(f"""{WITH} SELECT address, max(coalesce(contact_name, '')) AS contact_name, count(*) AS message_count, count(*) FILTER (type = 2) AS sent_count, count(*) FILTER (type = 1) AS received_count
FROM messages WHERE record_type IN (1, 2) GROUP BY address ORDER BY message_count DESC, address LIMIT 10""")
def top_contacts(spark, sf_dir):
    return analytics.top_contacts(messages(spark, sf_dir))


@query(f"""{WITH}, h AS (SELECT CAST((((date - 300 * 60) // 3600) % 24 + 24) % 24 AS INTEGER) AS hour, count(*) AS n FROM messages WHERE record_type IN (1, 2) GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS hour, coalesce(n, 0) AS count FROM range(24) r LEFT JOIN h ON h.hour = r.range""")
def hourly_distribution(spark, sf_dir):
    return analytics.hourly(messages(spark, sf_dir), -300)


@query(f"{WITH} SELECT strftime(make_timestamp(date * 1000000), '%Y-%m-%d') AS day, count(*) AS count FROM messages WHERE record_type IN (1, 2) GROUP BY 1")
def daily_trend(spark, sf_dir):
    return analytics.daily(messages(spark, sf_dir))


@query(f"""{WITH}, t AS (SELECT {_SUMMARY} FROM messages) SELECT * FROM (
SELECT 'messages' AS chart, 'Sent' AS name, total_sent AS value FROM t UNION ALL SELECT 'messages', 'Received', total_received FROM t UNION ALL
SELECT 'calls', 'Incoming', incoming_calls FROM t UNION ALL SELECT 'calls', 'Outgoing', outgoing_calls FROM t UNION ALL SELECT 'calls', 'Missed', missed_calls FROM t) WHERE value > 0""")
def pie_slices(spark, sf_dir):
    return analytics.pie_slices(analytics.summary(messages(spark, sf_dir)))


# ------------------------------------------------------------ store

_KEY = "record_type, address, date, type, coalesce(body, ''), coalesce(content_type, ''), coalesce(message_id, ''), coalesce(duration, 0)"


@query(f"{WITH_DAYS} SELECT {_ROW} FROM messages QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY id) = 1")
def dedup_first_wins(spark, sf_dir):
    rows = messages(spark, sf_dir, days=True)
    return _listed(store.first_wins(rows.unionByName(rows), ["id"]))


@query(f"{WITH} SELECT {_ROW} FROM messages WHERE id % 3 <> 0")
def dedup_anti_join(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumn("key_hash", store.key_hash())
    return _listed(store.unseen(rows, rows.filter("id % 3 = 0")))


# ------------------------------------------------------------ scalar functions

_PHONES = """SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN '' WHEN 1 THEN concat('(555) ', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), '-1234') WHEN 2 THEN concat('1555', lpad(CAST(c_custkey AS VARCHAR), 7, '0'))
WHEN 3 THEN concat('+44 20 ', c_custkey) WHEN 4 THEN 'BANK' WHEN 5 THEN CAST(c_custkey % 1000 AS VARCHAR) WHEN 6 THEN concat('555', lpad(CAST(c_custkey AS VARCHAR), 7, '0')) ELSE concat('555.', lpad(CAST(c_custkey AS VARCHAR), 7, '0'), ' x1') END AS number FROM customer"""


def _phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    padded = F.lpad(k.cast("string"), 7, "0")
    m = k % 8
    number = (
        F.when(m == 0, "")
        .when(m == 1, F.concat(F.lit("(555) "), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-1234")))
        .when(m == 2, F.concat(F.lit("1555"), padded))
        .when(m == 3, F.concat(F.lit("+44 20 "), k.cast("string")))
        .when(m == 4, "BANK")
        .when(m == 5, (k % 1000).cast("string"))
        .when(m == 6, F.concat(F.lit("555"), padded))
        .otherwise(F.concat(F.lit("555."), padded, F.lit(" x1")))
    )
    return _table(spark, sf_dir, "customer").select(k.alias("id"), number.alias("number"))


_DIGITS = "regexp_replace(number, '[^0-9]', '', 'g')"
_NORMAL = f"""CASE WHEN {_DIGITS} = '' THEN '' WHEN starts_with(number, '+') THEN concat('+', {_DIGITS}) WHEN length({_DIGITS}) = 10 THEN concat('+1', {_DIGITS})
WHEN length({_DIGITS}) = 11 AND starts_with({_DIGITS}, '1') THEN concat('+', {_DIGITS}) ELSE {_DIGITS} END"""


@query(f"WITH p AS ({_PHONES}) SELECT id, number, {_NORMAL} AS address FROM p")
def phone_normalize(spark, sf_dir):
    return _phones(spark, sf_dir).select("id", "number", phone.normalize(F.col("number")).alias("address"))


def _us(d: str, at: int, lead: str = "") -> str:
    return f"concat('{lead}(', substr({d}, {at}, 3), ') ', substr({d}, {at + 3}, 3), '-', substr({d}, {at + 6}))"


@query(
    f"""WITH p AS ({_PHONES}), q AS (SELECT id, number, {_DIGITS} AS d, regexp_replace(number, '[^0-9+]', '', 'g') AS k, regexp_replace(number, '^[+]1', '') AS b FROM p)
SELECT id,
 CASE WHEN number = '' THEN 'Unknown' WHEN length(d) = 11 AND starts_with(d, '1') THEN {_us("d", 2, "+1 ")} WHEN length(d) = 10 THEN {_us("d", 1)}
  WHEN length(d) > 10 THEN concat('+', substr(d, 1, length(d) - 10), ' ', substr(d, length(d) - 9, 3), ' ', substr(d, length(d) - 6, 3), ' ', substr(d, length(d) - 3)) ELSE number END AS in_list,
 CASE WHEN number = '' THEN '' WHEN starts_with(k, '+1') AND length(k) = 12 THEN {_us("k", 3, "+1 ")} WHEN starts_with(k, '+') THEN k WHEN length(k) = 11 AND starts_with(k, '1') THEN {_us("k", 2, "+1 ")}
  WHEN length(k) = 10 THEN {_us("k", 1, "+1 ")} ELSE number END AS in_activity,
 CASE WHEN number = '' THEN '' WHEN length(b) = 10 THEN {_us("b", 1)} ELSE number END AS in_search,
 CASE WHEN number = '' THEN '' WHEN length(d) = 10 THEN {_us("d", 1)} WHEN length(d) = 11 AND starts_with(d, '1') THEN {_us("d", 2, "+1 ")} ELSE number END AS in_summary
FROM q"""
)
def phone_format(spark, sf_dir):
    n = F.col("number")
    return _phones(spark, sf_dir).select("id", *[phone.format_number(n, s).alias(f"in_{s}") for s in ("list", "activity", "search", "summary")])


@query(
    f"""{WITH} SELECT id, CASE WHEN duration >= 3600 THEN concat(duration // 3600, 'h ', duration % 3600 // 60, 'm') ELSE concat(duration % 3600 // 60, 'm') END AS in_summary,
CASE WHEN duration < 60 THEN concat(duration, 's') ELSE concat(duration // 60, 'm ', duration % 60, 's') END AS in_activity, concat(duration // 60, ':', lpad(CAST(duration % 60 AS VARCHAR), 2, '0')) AS in_thread
FROM (SELECT id, duration * 37 AS duration FROM messages WHERE duration IS NOT NULL)"""
)
def duration_format(spark, sf_dir):
    rows = messages(spark, sf_dir).filter("duration IS NOT NULL")
    return rows.select("id", *[labels.duration(F.col("duration") * 37, s).alias(f"in_{s}") for s in ("summary", "activity", "thread")])


@query(f"{WITH}, h AS (SELECT id, CAST(floor(date / 3600) AS BIGINT) % 24 AS h FROM messages) SELECT id, CASE WHEN h = 0 THEN '12 AM' WHEN h = 12 THEN '12 PM' WHEN h < 12 THEN concat(h, ' AM') ELSE concat(h - 12, ' PM') END AS label FROM h")
def hour_label(spark, sf_dir):
    """The hour of every message as a label."""
    return messages(spark, sf_dir).select("id", labels.hour((F.floor(F.col("date") / 3600) % 24).cast("int")).alias("label"))


@query(
    f"""{WITH} SELECT id, CASE type WHEN 1 THEN 'Incoming call' WHEN 2 THEN 'Outgoing call' WHEN 3 THEN 'Missed call' WHEN 4 THEN 'Voicemail' WHEN 5 THEN 'Rejected call' WHEN 6 THEN 'Refused call' ELSE 'Call' END AS call_label,
CASE type WHEN 1 THEN 'Received' WHEN 2 THEN 'Sent' WHEN 3 THEN 'Draft' WHEN 4 THEN 'Outbox' WHEN 5 THEN 'Failed' WHEN 6 THEN 'Queued' ELSE 'Message' END AS box_label,
CASE WHEN record_type = 3 THEN 'call' ELSE 'message' END AS kind FROM (SELECT id, record_type, id % 8 AS type FROM messages)"""
)
def code_labels(spark, sf_dir):
    t = F.col("id") % 8
    return messages(spark, sf_dir).select("id", labels.call(t).alias("call_label"), labels.box(t).alias("box_label"), labels.kind(F.col("record_type")).alias("kind"))


@query(
    f"""{WITH} SELECT id, CASE WHEN subject <> '' AND NOT starts_with(subject, 'proto:') AND (contact_name IS NULL OR contact_name IN ('', '(Unknown)')) THEN subject
WHEN contact_name IS NULL OR contact_name IN ('', '(Unknown)') THEN {_us("address", 3, "+1 ")} ELSE contact_name END AS name FROM messages"""
)
def display_name(spark, sf_dir):
    return messages(spark, sf_dir).select("id", labels.display_name(F.col("contact_name"), F.col("subject"), F.col("address")).alias("name"))


_STRINGS = """SELECT id, CASE id % 6 WHEN 0 THEN ' NULL ' WHEN 1 THEN 'null' WHEN 2 THEN concat('nullable ', id) WHEN 3 THEN '' WHEN 4 THEN repeat(concat('word', id, ' '), 12) ELSE body END AS s FROM messages"""


def _strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, m = F.col("id").cast("string"), F.col("id") % 6
    s = F.when(m == 0, " NULL ").when(m == 1, "null").when(m == 2, F.concat(F.lit("nullable "), n)).when(m == 3, "").when(m == 4, F.repeat(F.concat(F.lit("word"), n, F.lit(" ")), F.lit(12))).otherwise(F.col("body"))
    return messages(spark, sf_dir).select("id", s.alias("s"))


@query(f"{WITH}, t AS ({_STRINGS}) SELECT id, CASE WHEN lower(trim(s)) = 'null' THEN '' ELSE s END AS plain, CASE WHEN s IS NULL THEN '' WHEN length(s) <= 50 THEN s ELSE concat(trim(substr(s, 1, 50)), '...') END AS preview FROM t")
def string_cleanup(spark, sf_dir):
    return _strings(spark, sf_dir).select("id", text.null_string(F.col("s")).alias("plain"), text.preview(F.col("s")).alias("preview"))


_TYPES = ["text/plain", " TEXT/X-vCard", "application/smil", "image/HEIC", "video/3gpp", "audio/3gpp", "audio/amr-wb", "application/json", "video/x-matroska", "image/png", ""]


@query(
    f"""{WITH}, t AS (SELECT id, ct, lower(trim(ct)) AS c FROM (SELECT id, {_TYPES}[id % {len(_TYPES)} + 1] AS ct FROM messages))
SELECT id, ct, starts_with(c, 'text/') OR c IN ('application/xml', 'application/json') AS is_text, contains(c, 'smil') AS is_smil, c IN ('text/vcard', 'text/x-vcard', 'text/directory') AS is_vcard,
contains(c, 'heic') OR contains(c, 'heif') AS is_heic, contains(c, '3gp') OR contains(c, '3g2') OR contains(c, 'video/x-matroska') AS video, contains(c, 'audio/amr') OR contains(c, 'audio/3gpp') AS audio FROM t"""
)
def mime_class(spark, sf_dir):
    """A content type on every message, and its classes."""
    c = F.col("ct")
    rows = messages(spark, sf_dir).select("id", F.get(F.array(*map(F.lit, _TYPES)), F.col("id") % len(_TYPES)).alias("ct"))
    return rows.select("id", "ct", mime.is_text(c).alias("is_text"), mime.is_smil(c).alias("is_smil"), mime.is_vcard(c).alias("is_vcard"), mime.is_heic(c).alias("is_heic"), mime.needs_video_conversion(c).alias("video"), mime.needs_audio_conversion(c).alias("audio"))


@query(
    f"""{WITH}, g AS (SELECT thread_id, list(DISTINCT address ORDER BY address) AS a FROM messages GROUP BY thread_id)
SELECT thread_id, CASE WHEN len(a) >= 3 THEN array_to_string(a, ',') ELSE '+15550001234' END AS address, CAST(len(a) AS INTEGER) AS participants FROM g"""
)
def group_address(spark, sf_dir):
    """Addresses are made distinct before they are gathered."""
    distinct = messages(spark, sf_dir).select("thread_id", "address").distinct()
    rows = distinct.groupBy("thread_id").agg(F.collect_list(F.struct("address", F.lit("151").alias("type"))).alias("addrs"))
    address, found = normalize.group_address(normalize.participants(F.col("addrs")), F.lit("(555) 000-1234"))
    return rows.select("thread_id", address.alias("address"), F.size(found).alias("participants"))


# ------------------------------------------------------------ custody

_ELEMENT = "concat('<sms address=\"', address, '\" date=\"', date, '\" type=\"', type, '\" />')"


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ['<sms address="', "address", '" date="', "date", '" type="', "type", '" />']
    raw = F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])
    return messages(spark, sf_dir).select("id", "address", raw.alias("raw")).withColumn("content_hash", custody.h2(F.col("raw")))


@query(f"{WITH} SELECT id, sha256({_ELEMENT}) AS content_hash FROM messages")
def record_hash(spark, sf_dir):
    return _elements(spark, sf_dir).select("id", "content_hash")


_CHAIN = f"""{WITH}, h AS (SELECT address, list(sha256({_ELEMENT}) ORDER BY id) AS l FROM messages GROUP BY address)
SELECT address, CAST(len(l) AS BIGINT) AS record_count, list_reduce(list_prepend('', l), lambda acc, x: sha256(acc || chr(10) || x)) AS chain_hash FROM h"""


@query(_CHAIN)
def chain_hash(spark, sf_dir):
    """Streamed fold, for chains of any length."""
    return custody.chain(_elements(spark, sf_dir), key="address", ordinal="id")


@query(_CHAIN)
def chain_hash_column(spark, sf_dir):
    """The same fold as a column over a gathered array, for short chains."""
    rows = _elements(spark, sf_dir).groupBy("address").agg(F.array_sort(F.collect_list(F.struct("id", "content_hash"))).alias("l"))
    return rows.select("address", F.size("l").cast("bigint").alias("record_count"), custody.chain_column(F.transform("l", lambda x: x["content_hash"])).alias("chain_hash"))


@query(f"{WITH} SELECT thread_id AS id, count(*) AS record_count FROM messages GROUP BY thread_id ORDER BY id DESC LIMIT 1")
def imports_latest(spark, sf_dir):
    return custody.latest(messages(spark, sf_dir).groupBy(F.col("thread_id").alias("id")).agg(F.count("*").alias("record_count")))


_SMS = """concat('<sms address="', address, '" date="', date * 1000 + 7, '" type="', type, '" thread_id="', thread_id, '" body="', replace(body, '"', '&quot;'), '" />')"""


def _sms() -> Column:
    body = F.replace("body", F.lit('"'), F.lit("&quot;"))
    parts = [F.lit('<sms address="'), F.col("address"), F.lit('" date="'), F.col("date") * 1000 + 7, F.lit('" type="'), F.col("type"), F.lit('" thread_id="'), F.col("thread_id"), F.lit('" body="'), body, F.lit('" />')]
    return F.concat(*[p.cast("string") for p in parts])


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of every thread as one backup file."""
    return _backups(messages(spark, sf_dir).filter("record_type <> 3").select("id", "thread_id", _sms().alias("raw")))


_HEAD, _FOOT = "<?xml version='1.0' encoding='UTF-8'?>\n<!-- <sms -->\n<smses>\n", "\n</smses>"


def _backups(rows: DataFrame) -> DataFrame:
    """Backup files of the elements in rows(id, thread_id, raw), one for each thread."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "raw"))), lambda x: x["raw"])
    whole = F.concat(F.lit(_HEAD), F.array_join(ordered, "\n"), F.lit(_FOOT))
    return rows.groupBy("thread_id").agg(whole.alias("text")).select(F.concat(F.lit("thread-"), F.col("thread_id").cast("string"), F.lit(".xml")).alias("path"), F.encode("text", "UTF-8").alias("content"))


@query(
    f"""{WITH} SELECT concat('thread-', thread_id, '.xml') AS file, row_number() OVER (PARTITION BY thread_id ORDER BY id) - 1 AS ordinal, 1 AS record_type, address, date, type, thread_id, body, sha256({_SMS}) AS content_hash
FROM messages WHERE record_type <> 3"""
)
def xml_import(spark, sf_dir):
    """Backup files split into elements, hashed as they are and normalised."""
    return normalize.messages(backup.split(_files(spark, sf_dir))).select("file", "ordinal", "record_type", "address", "date", "type", "thread_id", "body", "content_hash")


@query(
    f"""{WITH}, h AS (SELECT thread_id, list(sha256({_SMS}) ORDER BY id) AS l FROM messages WHERE record_type <> 3 GROUP BY thread_id)
SELECT concat('thread-', thread_id, '.xml') AS file, CAST(len(l) AS BIGINT) AS record_count, list_reduce(list_prepend('', l), lambda acc, x: sha256(acc || chr(10) || x)) AS chain_hash FROM h"""
)
def import_rows(spark, sf_dir):
    """The custody rows that an import of these files would write."""
    found = _files(spark, sf_dir)
    return custody.import_rows(normalize.messages(backup.split(found)), backup.file_hashes(found)).select("file", "record_count", "chain_hash")


_HEAD_SQL = "concat('" + _HEAD.replace("'", "''").replace("\n", "', chr(10), '") + "')"


@query(
    f"""{WITH}, f AS (SELECT thread_id, concat({_HEAD_SQL}, string_agg({_SMS}, chr(10) ORDER BY id), chr(10), '</smses>') AS text FROM messages WHERE record_type <> 3 GROUP BY thread_id)
SELECT concat('thread-', thread_id, '.xml') AS file, sha256(text) AS file_hash FROM f"""
)
def import_file_hash(spark, sf_dir):
    """H1 of the files whose records import_rows counts."""
    return backup.file_hashes(_files(spark, sf_dir))


_CALL = """concat('<call number="', address, '" duration="', duration, '" date="', date * 1000 + 7, '" type="', type, '" presentation="', id % 3, '" subscription_id="sub', id % 2, '" contact_name="', coalesce(contact_name, ''), '" />')"""


def _call() -> Column:
    n = F.col("id")
    parts = ['<call number="', F.col("address"), '" duration="', F.col("duration"), '" date="', F.col("date") * 1000 + 7, '" type="', F.col("type"), '" presentation="', n % 3, '" subscription_id="sub', n % 2, '" contact_name="', F.coalesce("contact_name", F.lit("")), '" />']
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(
    f"""{WITH} SELECT concat('thread-', thread_id, '.xml') AS file, row_number() OVER (PARTITION BY thread_id ORDER BY id) - 1 AS ordinal, 3 AS record_type, address, date, type, CAST(0 AS BIGINT) AS thread_id,
duration, id % 3 AS presentation, concat('sub', id % 2) AS subscription_id, coalesce(contact_name, '') AS contact_name, CAST(NULL AS VARCHAR) AS body, sha256({_CALL}) AS content_hash FROM messages WHERE record_type = 3"""
)
def xml_import_calls(spark, sf_dir):
    """Call elements split, hashed and normalised."""
    found = backup.split(_backups(messages(spark, sf_dir).filter("record_type = 3").select("id", "thread_id", _call().alias("raw"))))
    return normalize.messages(found).select("file", "ordinal", "record_type", "address", "date", "type", "thread_id", "duration", "presentation", "subscription_id", "contact_name", "body", "content_hash")


#: Multimedia elements: markup, two texts, an image (with bytes, with none that decode, or without any), two or three participants.
_MMS = """concat('<mms address="', address, '" date="', date * 1000 + 7, '" msg_box="', type, '" ct_t="application/vnd.wap.multipart.related" m_id="m', id, '" sub="', CASE id % 3 WHEN 0 THEN 'null' ELSE concat('About ', id) END, '" m_size="', id % 1000, '" rr="129" read_status="x" sim_slot="', id % 2, '" read="1"><parts><part ct="application/smil" text="markup" /><part ct="text/plain" text="', replace(body, '"', '&quot;'), '" /><part ct="image/png" text="" data="', CASE id % 4 WHEN 0 THEN base64(encode(concat('image ', id))) WHEN 1 THEN '*' ELSE '' END, '" /><part ct="text/plain" text=" and ', id, ' " /></parts><addrs><addr address="', address, '" type="151" /><addr address="+19990000001" type="137" />', CASE WHEN id % 2 = 0 THEN '<addr address="+19990000002" type="130" />' ELSE '' END, '</addrs></mms>')"""


def _mms() -> Column:
    n = F.col("id")
    data = F.when(n % 4 == 0, F.base64(F.encode(F.concat(F.lit("image "), n.cast("string")), "UTF-8"))).when(n % 4 == 1, "*").otherwise("")
    third = F.when(n % 2 == 0, '<addr address="+19990000002" type="130" />').otherwise("")
    parts = [
        '<mms address="', F.col("address"), '" date="', F.col("date") * 1000 + 7, '" msg_box="', F.col("type"), '" ct_t="application/vnd.wap.multipart.related" m_id="m', n, '" sub="',
        F.when(n % 3 == 0, "null").otherwise(F.concat(F.lit("About "), n.cast("string"))), '" m_size="', n % 1000, '" rr="129" read_status="x" sim_slot="', n % 2,
        '" read="1"><parts><part ct="application/smil" text="markup" /><part ct="text/plain" text="', F.replace("body", F.lit('"'), F.lit("&quot;")), '" /><part ct="image/png" text="" data="', data,
        '" /><part ct="text/plain" text=" and ', n, ' " /></parts><addrs><addr address="', F.col("address"), '" type="151" /><addr address="+19990000001" type="137" />', third, "</addrs></mms>",
    ]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(
    f"""{WITH} SELECT concat('thread-', thread_id, '.xml') AS file, row_number() OVER (PARTITION BY thread_id ORDER BY id) - 1 AS ordinal, 2 AS record_type, date, type,
concat(address, CASE WHEN id % 2 = 0 THEN ',+19990000001,+19990000002' ELSE '' END) AS address, concat(address, ',+19990000001', CASE WHEN id % 2 = 0 THEN ',+19990000002' ELSE '' END) AS addresses,
CASE WHEN type = 1 THEN '+19990000001' ELSE '' END AS sender, trim(concat(body, '  and ', id)) AS body, CASE WHEN id % 4 = 0 THEN 'image/png' ELSE '' END AS media_type, CASE WHEN id % 4 = 0 THEN concat('image ', id) END AS media,
CASE id % 3 WHEN 0 THEN '' ELSE concat('About ', id) END AS subject, concat('m', id) AS message_id, id % 1000 AS message_size, CAST(129 AS BIGINT) AS read_report, CAST(0 AS BIGINT) AS read_status, id % 2 AS sim_slot, sha256({_MMS}) AS content_hash
FROM messages WHERE record_type = 2"""
)
def xml_import_mms(spark, sf_dir):
    """Multimedia elements with parts and participants: group address, sender, body text and first media."""
    rows = normalize.messages(backup.split(_backups(messages(spark, sf_dir).filter("record_type = 2").select("id", "thread_id", _mms().alias("raw")))))
    own = ["file", "ordinal", "record_type", "date", "type", "address", "sender", "body", "media_type", "subject", "message_id", "message_size", "read_report", "read_status", "sim_slot", "content_hash"]
    return rows.select(*own, F.array_join("addresses", ",").alias("addresses"), F.decode("media_data", "UTF-8").alias("media"))


#: Tasks that write backup files.
WRITERS = 50
#: Mixed backups: messages, multimedia and calls of a thread in one file, as real ones are.
_MIXED = f"""{WITH}, e AS (SELECT *, CASE record_type WHEN 1 THEN {_SMS} WHEN 2 THEN {_MMS} ELSE {_CALL} END AS raw FROM messages),
mixed AS (SELECT id, record_type, date, type, concat('thread_id=', thread_id) AS file, row_number() OVER w - 1 AS ordinal, sha256(raw) AS content_hash, duration,
CAST(length({_HEAD_SQL}) + sum(length(raw) + 1) OVER w - length(raw) - 1 AS BIGINT) AS start, CAST(length({_HEAD_SQL}) + sum(length(raw) + 1) OVER w - 1 AS BIGINT) AS stop,
CASE WHEN record_type = 2 AND id % 2 = 0 THEN concat(address, ',+19990000001,+19990000002') ELSE address END AS address,
CASE record_type WHEN 1 THEN body WHEN 2 THEN trim(concat(body, '  and ', id)) END AS body FROM e WINDOW w AS (PARTITION BY thread_id ORDER BY id))"""


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a mixed backup file for each thread, written line by line: no file is one value."""
    kind = F.col("record_type")
    raw = F.when(kind == 1, _sms()).when(kind == 2, _mms()).otherwise(_call())
    folder = f"{shared_folder(spark)}/backups-{uuid.uuid4().hex}"
    rows = messages(spark, sf_dir).select("thread_id", F.lit(1).alias("part"), "id", raw.alias("value"))
    ends = F.explode(F.array(*[F.struct(F.lit(part).alias("part"), F.lit(None).cast("long").alias("id"), F.lit(text.strip("\n")).alias("value")) for part, text in ((0, _HEAD), (2, _FOOT))]))
    rows = rows.filter("value IS NOT NULL").unionByName(rows.select("thread_id").distinct().select("thread_id", ends.alias("end")).select("thread_id", "end.*"))
    # a number of its own, so that a thread's lines stay in one task and its file
    order = ["thread_id", "part", "id"]
    rows.repartition(WRITERS, "thread_id").sortWithinPartitions(*order).select("value", "thread_id").write.partitionBy("thread_id").text(folder)
    return folder


def _thread() -> Column:
    return F.regexp_extract("file", r"thread_id=\d+", 0)


@query(f"{_MIXED} SELECT file, ordinal, start, stop, record_type, address, date, type, body, duration, content_hash FROM mixed")
def xml_import_ranges(spark, sf_dir):
    """Mixed backup files, cut at byte ranges of 16 kB that most elements know nothing of."""
    raw = ranges.elements(ranges.pieces(spark, _written(spark, sf_dir), 16 << 10, "*.txt"))
    return normalize.messages(raw, "start", "stop").withColumn("file", _thread()).select("file", "ordinal", "start", "stop", "record_type", "address", "date", "type", "body", "duration", "content_hash")


@query(
    f"""{_MIXED}, first AS (SELECT * FROM mixed QUALIFY row_number() OVER (PARTITION BY record_type, address, date, type, coalesce(body, ''), CASE WHEN record_type = 2 THEN id END, coalesce(duration, 0) ORDER BY file, ordinal) = 1)
SELECT row_number() OVER (ORDER BY file, ordinal) AS id, record_type, address, date, type, body, duration, content_hash FROM first"""
)
def store_messages(spark, sf_dir):
    """What a store holds after two imports of the same files by ranges: each record once."""
    found = ranges.pieces(spark, _written(spark, sf_dir), 64 << 10, "*.txt")
    s = store.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    s.append(found)
    s.append(found)
    return s.messages().select("id", "record_type", "address", "date", "type", "body", "duration", "content_hash")


@query(f"{_MIXED} SELECT content_hash, substr(concat('image ', id), 4, 6) AS part FROM mixed WHERE record_type = 2 AND id % 4 = 0")
def media_chunks(spark, sf_dir):
    """Bytes 3 to 8 of every medium of a store that keeps them in chunks of four bytes."""
    s = store.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", chunk=4)
    s.append(ranges.pieces(spark, _written(spark, sf_dir), 64 << 10, "*.txt"))
    return s.media_range(3, 8).select("content_hash", F.decode("media_data", "UTF-8").alias("part"))


@query(f"{WITH} SELECT id, date, address FROM messages ORDER BY date, id LIMIT 50 OFFSET 700")
def activity_deep_page(spark, sf_dir):
    """A page far down a table in time order: the files of the page are read."""
    line = Timeline(spark, f"{shared_folder(spark)}/timeline-{uuid.uuid4().hex}")
    line.write(messages(spark, sf_dir).select("id", "date", "address"), 2000)
    return line.page(50, 700)


# ------------------------------------------------------------ search

_WORDS = "WITH d AS (SELECT conv_id * 1000000 + turn AS id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}\\p{Co}]+') AS w FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), F.col("role").alias("address"), F.lit("").alias("contact_name"), F.col("text").alias("body"), F.col("turn").alias("date"))


def _found(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    return search.matches(search.postings(_turns(spark, sf_dir)), search.parse(expression)).distinct()


@query(f"{_WORDS} SELECT id FROM d WHERE list_contains(w, 'the')")
def search_term(spark, sf_dir):
    return _found(spark, sf_dir, "The")


@query(f"{_WORDS} SELECT id FROM d WHERE list_contains(w, 'the') AND list_contains(w, 'with')")
def search_and(spark, sf_dir):
    return _found(spark, sf_dir, "the AND with")


@query(f"{_WORDS} SELECT id FROM d WHERE list_contains(w, 'from') OR list_contains(w, 'with')")
def search_or(spark, sf_dir):
    return _found(spark, sf_dir, "from OR with")


@query(f"{_WORDS} SELECT id FROM d WHERE list_contains(w, 'the') AND NOT list_contains(w, 'with')")
def search_not(spark, sf_dir):
    return _found(spark, sf_dir, "the NOT with")


@query(f"{_WORDS} SELECT id FROM d WHERE contains(concat(' ', array_to_string(w, ' '), ' '), ' of the ')")
def search_phrase(spark, sf_dir):
    return _found(spark, sf_dir, '"of the"')


@query(f"{_WORDS} SELECT id FROM d WHERE contains(concat(' ', array_to_string(w, ' ')), ' whi')")
def search_prefix(spark, sf_dir):
    return _found(spark, sf_dir, "whi*")


@query(f"{_WORDS} SELECT id FROM d WHERE w[1] = 'the'")
def search_first(spark, sf_dir):
    return _found(spark, sf_dir, "^the")


@query(
    f"""{_WORDS}, t AS (SELECT id, i, w[i] AS t FROM d, unnest(range(1, len(w) + 1)) AS r(i) WHERE w[i] IN ('with', 'from'))
SELECT DISTINCT a.id FROM t a JOIN t b ON a.id = b.id AND a.t = 'with' AND b.t = 'from' AND abs(a.i - b.i) <= 6"""
)
def search_near(spark, sf_dir):
    return _found(spark, sf_dir, "NEAR(with from, 5)")


@query(
    f"""{_WORDS}, s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d), x AS (SELECT id, len(w) AS dl, len(list_filter(w, lambda t: t = 'with')) AS tf FROM d),
f AS (SELECT count(*) AS df FROM x WHERE tf > 0)
SELECT id, round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM x, s, f WHERE tf > 0"""
)
def search_bm25(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    index, tree = search.postings(rows), search.parse("with")
    return search.scores(index, search.lengths(rows), search.matches(index, tree), tree).select("id", F.round("score", 6).alias("score"))


_TOKEN = "[\\p{L}\\p{N}\\p{Co}]"
#: Windows of 50 terms for the phrases `with` and `of the`: their scores at each instance and at its sentence, the best one, its text.
_SNIPPETS = f"""{_WORDS}, t AS (SELECT conv_id * 1000000 + turn AS id, role, text FROM conversations), l AS (SELECT id, regexp_extract_all(text, '{_TOKEN}+|[^\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS l FROM t),
p AS (SELECT id, k, l[k] AS piece, regexp_matches(l[k], '^{_TOKEN}') AS tok FROM l, unnest(range(1, len(l) + 1)) AS r(k)),
q AS (SELECT *, sum(CASE WHEN tok THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) - 1 AS pos, lag(piece) OVER (PARTITION BY id ORDER BY k) AS before FROM p),
i AS (SELECT id, i - 1 AS pos, 0 AS ph, 1 AS len FROM d, unnest(range(1, len(w) + 1)) AS r(i) WHERE w[i] = 'with' UNION ALL SELECT id, i - 1, 1, 2 FROM d, unnest(range(1, len(w))) AS r(i) WHERE w[i] = 'of' AND w[i + 1] = 'the'),
f AS (SELECT id, pos FROM q WHERE tok AND (pos = 0 OR regexp_matches(before, '[.:][ \\t\\n\\r]*$'))),
c AS (SELECT id, pos, ph, 0 AS kind, pos AS s FROM i UNION ALL SELECT i.id, i.pos, i.ph, 1, max(f.pos) FROM i JOIN f ON i.id = f.id AND f.pos < i.pos JOIN d ON d.id = i.id WHERE len(w) > 50 GROUP BY ALL),
v AS (SELECT c.id, c.pos, c.ph, c.kind, c.s, 1000 * count(DISTINCT b.ph) + count(b.ph) - count(DISTINCT b.ph) + CASE WHEN c.kind = 0 THEN 0 WHEN c.s = 0 THEN 120 ELSE 100 END AS score, min(b.pos) AS f, arg_max(b.pos + b.len, b.pos * 2 + b.ph) AS e
FROM c LEFT JOIN i b ON b.id = c.id AND b.pos >= c.s AND b.pos < c.s + 50 GROUP BY c.id, c.pos, c.ph, c.kind, c.s),
u AS (SELECT v.id, len(w) AS n, CASE WHEN kind = 1 THEN s ELSE greatest(0, least(f - greatest(0, 50 - (e - f)) // 2, len(w) - 50)) END AS s FROM v JOIN d ON d.id = v.id QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY score DESC, pos, ph, kind) = 1),
m AS (SELECT id, pos, pos + len - 1 AS last FROM i),
o AS (SELECT u.id, u.s, u.n, q.k, concat(CASE WHEN a.id IS NULL THEN '' ELSE '<mark>' END, piece, CASE WHEN b.id IS NULL THEN '' ELSE '</mark>' END) AS piece FROM u JOIN q ON q.id = u.id AND q.pos < s + 50 AND (q.pos >= s OR s = 0) AND (tok OR q.pos < s + 49 OR s + 50 >= n)
LEFT JOIN m a ON tok AND a.id = q.id AND a.pos = q.pos LEFT JOIN m b ON tok AND b.id = q.id AND b.pos >= s AND b.pos <= q.pos AND (b.last = q.pos OR b.last > q.pos AND q.pos = s + 49)),
snippets AS (SELECT id, concat(CASE WHEN s > 0 THEN '...' ELSE '' END, string_agg(piece, '' ORDER BY k), CASE WHEN s + 50 < n THEN '...' ELSE '' END) AS snippet FROM o GROUP BY id, s, n)"""


@query(f"{_SNIPPETS} SELECT id, snippet FROM snippets")
def search_snippets(spark, sf_dir):
    """The best window of every turn that matches."""
    rows, tree = _turns(spark, sf_dir), search.parse('with OR "of the"')
    found = search.matches(search.postings(rows), tree)
    return rows.join(found, "id", "left_semi").select("id", search.snippet(F.col("body"), tree).alias("snippet"))


def _kept(spark: SparkSession, sf_dir: str) -> postings.Index:
    """An index that was appended to twice, and lost and regained some rows between."""
    rows = _turns(spark, sf_dir)
    index = postings.Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", span=8_000_000, block=16)
    index.append(rows.filter("date % 2 = 0"))
    index.delete(rows.filter("date = 2"))
    index.append(rows.filter("date % 2 = 1 OR date = 2"))
    return index


_BM25 = """s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d), g AS (SELECT ph, count(*) AS df FROM x GROUP BY ph),
best AS (SELECT id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl))), 6) AS score FROM x JOIN g USING (ph) JOIN d USING (id), s GROUP BY id ORDER BY score, id LIMIT 100)"""


@query(f"{_SNIPPETS}, x AS (SELECT id, ph, count(*) AS tf FROM i GROUP BY ALL), {_BM25} SELECT id, role AS address, '' AS contact_name, text AS body, id % 1000000 AS date, snippet, score FROM best JOIN t USING (id) JOIN snippets USING (id)")
def search_results(spark, sf_dir):
    """Ranked rows with snippets, from a kept index."""
    found = search.search(_turns(spark, sf_dir), 'with OR "of the"', limit=100, index=_kept(spark, sf_dir))
    return found.withColumn("score", F.round("score", 6))


@query(f"{_WORDS}, x AS (SELECT id, w[i] AS ph, count(*) AS tf FROM d, unnest(range(1, len(w) + 1)) AS r(i) WHERE w[i] IN ('with', 'from', 'river') GROUP BY ALL), {_BM25.replace('LIMIT 100', 'LIMIT 20')} SELECT id, score FROM best")
def search_top(spark, sf_dir):
    """The best 20 rows by block maxima."""
    return _kept(spark, sf_dir).top(search.parse("with OR from OR river"), 20).withColumn("score", F.round("score", 6))


# ------------------------------------------------------------ export, control, cards


@query(f"""{WITH}, m AS (SELECT * FROM messages WHERE record_type IN (1, 2)) SELECT name FROM (
SELECT unnest(['id', 'address', 'body', 'type', 'date', 'read', 'thread_id']) AS name UNION ALL SELECT 'subject' FROM m WHERE subject <> '' GROUP BY 1 UNION ALL SELECT 'media_type' FROM m WHERE media_type <> '' GROUP BY 1
UNION ALL SELECT 'contact_name' FROM m WHERE contact_name <> '' GROUP BY 1 UNION ALL SELECT 'content_type' FROM m WHERE content_type <> '' GROUP BY 1 UNION ALL SELECT 'message_id' FROM m WHERE message_id <> '' GROUP BY 1)""")
def export_union_columns(spark, sf_dir):
    return export.columns_in_use(export.split(messages(spark, sf_dir))[0])


@query(f"""{WITH} SELECT address, coalesce(body, '') AS body, coalesce(contact_name, '') AS contact_name, content_type, CAST(date AS VARCHAR) AS date, CAST(id AS VARCHAR) AS id, media_type,
CAST(read AS VARCHAR) AS read, subject, CAST(thread_id AS VARCHAR) AS thread_id, CAST(type AS VARCHAR) AS type FROM messages WHERE record_type IN (1, 2)""")
def export_csv(spark, sf_dir):
    return export.csv_rows(export.split(messages(spark, sf_dir))[0])


@query(f"{WITH} SELECT CASE WHEN record_type = 3 THEN 'call' ELSE 'message' END AS kind, count(*) AS n FROM messages GROUP BY 1")
def export_json(spark, sf_dir):
    return export.json_rows(messages(spark, sf_dir)).groupBy("kind").agg(F.count("json").alias("n"))


@query("SELECT o_orderkey AS session_id, o_custkey AS user_id, c_name AS username FROM orders JOIN customer ON o_custkey = c_custkey WHERE CAST(floor(epoch(o_orderdate)) AS BIGINT) >= 880000000")
def session_join(spark, sf_dir):
    sessions = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("expires_at"))
    users = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    return control.valid_sessions(sessions, users, 880_000_000).select("session_id", "user_id", "username")


@query("SELECT user_id, arg_max(props, event_id) AS settings FROM events GROUP BY user_id")
def settings_latest(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", F.col("props").alias("settings"), F.col("event_id").alias("updated_at"))
    return control.settings_latest(rows)


@query(
    """SELECT c_custkey AS id, c_name AS name, concat('+1555', lpad(CAST(c_custkey AS VARCHAR), 7, '0')) AS number, CASE c_custkey % 2 WHEN 0 THEN 'Mobile, Preferred' ELSE 'Home' END AS label,
concat(c_custkey, ' Main St, Town, CA 9', c_custkey % 10) AS address, concat('02/0', c_custkey % 9 + 1, '/1990') AS birthday FROM customer"""
)
def vcard_parse(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    lines = [
        F.lit("BEGIN:VCARD"), F.lit("VERSION:3.0"), F.concat(F.lit("FN:"), F.col("c_name")),
        F.concat(F.when(F.col("c_custkey") % 2 == 0, "TEL;CELL;PREF:+1555").otherwise("TEL;TYPE=HOME:+1555"), F.lpad(k, 7, "0")),
        F.concat(F.lit("ADR:;;"), k, F.lit(" Main\r\n  St;Town;CA;9"), (F.col("c_custkey") % 10).cast("string"), F.lit(";")),
        F.concat(F.lit("BDAY:1990020"), (F.col("c_custkey") % 9 + 1).cast("string")), F.lit("END:VCARD"),
    ]
    cards = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), vcard.parse_card(F.concat_ws("\r\n", *lines)).alias("c"))
    one = F.get("c.phone_numbers", F.lit(0))
    return cards.select("id", F.col("c.name").alias("name"), one["number"].alias("number"), one["type"].alias("label"), vcard.format_address(F.get("c.addresses", F.lit(0))).alias("address"), vcard.format_birthday(F.col("c.birthday")).alias("birthday"))


@query(f"{WITH} SELECT address, id, row_number() OVER (PARTITION BY address ORDER BY date, id) AS n FROM messages QUALIFY n <= 3")
def first_rows_of_address(spark, sf_dir):
    own = W.partitionBy("address").orderBy("date", "id")
    return messages(spark, sf_dir).select("address", "id", F.row_number().over(own).cast("bigint").alias("n")).filter("n <= 3")


@query(
    f"""{WITH} SELECT id, CASE WHEN record_type = 3 THEN 'call' ELSE 'message' END AS kind, CASE WHEN record_type = 3 THEN
concat('{{"id":', id, ',"number":"', address, '","duration":', duration, ',"date":', date, ',"type":', type, CASE WHEN contact_name <> '' THEN concat(',"contact_name":"', contact_name, '"') ELSE '' END, '}}') ELSE
concat('{{"id":', id, ',"address":"', address, '"', CASE WHEN body IS NOT NULL THEN concat(',"body":', CAST(to_json(body) AS VARCHAR)) ELSE '' END, ',"type":', type, ',"date":', date, ',"read":', read, ',"thread_id":', thread_id,
CASE WHEN subject <> '' THEN concat(',"subject":"', subject, '"') ELSE '' END, CASE WHEN media_type <> '' THEN concat(',"media_type":"', media_type, '"') ELSE '' END, CASE WHEN contact_name <> '' THEN concat(',"contact_name":"', contact_name, '"') ELSE '' END,
CASE WHEN content_type <> '' THEN concat(',"content_type":"', content_type, '"') ELSE '' END, '}}') END AS json FROM messages"""
)
def export_json_rows(spark, sf_dir):
    """The JSON of every message and call, whole."""
    rows = export.json_rows(messages(spark, sf_dir))
    return rows.select(F.get_json_object("json", "$.id").cast("bigint").alias("id"), "kind", "json")


@query("SELECT o_orderkey AS session_id, o_custkey AS user_id FROM orders WHERE CAST(floor(epoch(o_orderdate)) AS BIGINT) < 880000000")
def sessions_expired(spark, sf_dir):
    sessions = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("expires_at"))
    return control.expired_sessions(sessions, 880_000_000).select("session_id", "user_id")


@query("SELECT c_custkey AS id, trim(regexp_replace(lower(concat('__', c_name, ' & Co.')), '[^a-z0-9]+', '_', 'g'), '_') AS username FROM customer")
def usernames(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.sanitize_username(F.concat(F.lit("__"), F.col("c_name"), F.lit(" & Co."))).alias("username"))


@query("SELECT c_custkey AS id, substr(c_name, 3, 6) AS part FROM customer")
def media_slice(spark, sf_dir):
    """Bytes 2 to 7 of every blob."""
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.encode("c_name", "UTF-8").alias("media_data"))
    return reads.slice_media(rows, *reads.byte_range("bytes=2-7", 8)).select("id", F.decode("media_data", "UTF-8").alias("part"))


@query(
    f"""{WITH}, d AS (SELECT id, date, CAST(floor(({END} - date) / 86400) AS BIGINT) AS days, make_timestamp(date * 1000000) AS t, make_timestamp(CAST({END} AS BIGINT) * 1000000) AS now FROM messages)
SELECT id, CASE WHEN days = 0 THEN strftime(t, 'Today at %-I:%M %p') WHEN days = 1 THEN strftime(t, 'Yesterday at %-I:%M %p') WHEN days < 7 THEN strftime(t, '%A at %-I:%M %p')
WHEN year(t) = year(now) THEN strftime(t, '%b %-d, %-I:%M %p') ELSE strftime(t, '%b %-d, %Y, %-I:%M %p') END AS shown FROM d"""
)
def relative_dates(spark, sf_dir):
    return messages(spark, sf_dir).select("id", labels.relative_date(F.col("date"), F.lit(END)).alias("shown"))


@query(
    f"""{WITH}, g AS (SELECT thread_id, count(DISTINCT address) AS n, count(*) AS total, count(*) FILTER (WHERE record_type = 1) AS done FROM messages GROUP BY thread_id)
SELECT thread_id, n > 1 AS is_group, CAST(least(floor(done / total * 100 + 0.5), 100) AS INTEGER) AS percent FROM g"""
)
def thread_progress(spark, sf_dir):
    """Whether a thread is a group, and the share of its records of one kind as progress."""
    rows = messages(spark, sf_dir).groupBy("thread_id").agg(F.array_distinct(F.array(F.min("address"), F.max("address"))).alias("addresses"), F.count("*").alias("total"), F.count_if(F.col("record_type") == 1).alias("done"))
    return rows.select("thread_id", labels.is_group(F.col("addresses")).alias("is_group"), labels.progress_percent(F.col("done"), F.col("total")).alias("percent"))


@query(
    f"""{WITH}, m AS (SELECT * FROM messages WHERE date >= {START} AND date <= {END}), t AS (SELECT * FROM m WHERE record_type <> 3)
SELECT 'total' AS figure, '' AS name, count(*) AS n FROM m UNION ALL
SELECT * FROM (SELECT 'contact', address, count(*) AS n FROM t GROUP BY address ORDER BY n DESC, address LIMIT 5) UNION ALL
SELECT 'hour', CAST(h AS VARCHAR), coalesce(n, 0) FROM range(24) r(h) LEFT JOIN (SELECT CAST(floor((date - 18000) / 3600) AS BIGINT) % 24 AS h, count(*) AS n FROM t GROUP BY 1) USING (h) UNION ALL
SELECT 'day', strftime(make_timestamp(date * 1000000), '%Y-%m-%d'), count(*) FROM t GROUP BY 2"""
)
def analytics_bundle(spark, sf_dir):
    """All figures of one date range, offset five hours west."""
    found = analytics.analytics(messages(spark, sf_dir), START, END, *analytics.parameters("5", "-300"))
    shape = lambda df, figure, name, n: df.select(F.lit(figure).alias("figure"), name.cast("string").alias("name"), F.col(n).alias("n"))
    return (
        shape(found["summary"], "total", F.lit(""), "total_messages")
        .unionByName(shape(found["top_contacts"], "contact", F.col("address"), "message_count"))
        .unionByName(shape(found["hourly"], "hour", F.col("hour"), "count"))
        .unionByName(shape(found["daily"], "day", F.col("day"), "count"))
    )


@query(
    """SELECT c_custkey AS id, concat('Café ', c_custkey) AS name, CASE c_custkey % 3 WHEN 0 THEN concat('data:image/png;base64,QUJD', c_custkey) WHEN 1 THEN concat('https://host/', c_custkey, '.jpg') END AS photo FROM customer"""
)
def vcard_media(spark, sf_dir):
    """Quoted-printable names; pictures as data, as links, and as neither."""
    k = F.col("c_custkey").cast("string")
    picture = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("PHOTO;ENCODING=BASE64;TYPE=PNG:QU\r\n JD"), k)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("PHOTO:https://host/"), k, F.lit(".jpg"))).otherwise(F.concat(F.lit("PHOTO:file-"), k))
    card = F.concat_ws("\r\n", F.lit("BEGIN:VCARD"), F.concat(F.lit("FN;ENCODING=QUOTED-PRINTABLE:Caf=E9 "), k), picture, F.lit("END:VCARD"))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), vcard.parse_card(card).alias("c")).select("id", F.col("c.name").alias("name"), F.col("c.photo").alias("photo"))
