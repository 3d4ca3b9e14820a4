"""Raw elements to rows of the message table, in column expressions.

A record whose date is not a whole number of milliseconds is dropped. Of the
other numbers those that do not parse are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.functions import mime, phone
from missive.functions.text import null_string, trim, whole
from missive.schema import CALL, MESSAGES, MMS, SMS

FROM = 137  # address type of a sender


def _attr(name: str) -> Column:
    return F.coalesce(F.col("attrs")[name], F.lit(""))


def participants(addrs: Column) -> Column:
    """Normalised addresses in source order, without empty ones, with their types."""
    each = F.transform(addrs, lambda a: F.struct(phone.normalize(F.coalesce(a["address"], F.lit(""))).alias("address"), whole(F.coalesce(a["type"], F.lit(""))).alias("type")))
    return F.filter(each, lambda a: a["address"] != "")


def group_address(found: Column, own: Column) -> tuple[Column, Column]:
    """(address, addresses): three distinct participants or more make a group, named
    by all of them in order; fewer go by the record's own address."""
    distinct = F.array_sort(F.array_distinct(F.transform(found, lambda a: a["address"])))
    return F.when(F.size(distinct) >= 3, F.array_join(distinct, ",")).otherwise(phone.normalize(own)), distinct


def sender(found: Column) -> Column:
    """The last participant marked as sender, else the first, else ''."""
    marked = F.filter(found, lambda a: a["type"] == FROM)
    return F.coalesce(F.get(marked, F.size(marked) - 1)["address"], F.get(found, F.lit(0))["address"], F.lit(""))


def _is_card(p: Column) -> Column:
    return mime.is_vcard(p["ct"]) & (p["data"] != "")


def _is_media(p: Column) -> Column:
    return (p["ct"] != "") & (p["data"] != "") & ~mime.is_text(p["ct"])


def _filled(parts: Column) -> Column:
    """Parts without presentation markup, their missing attributes empty."""
    shown = F.transform(parts, lambda p: F.struct(*[F.coalesce(p[c], F.lit("")).alias(c) for c in ("ct", "text", "data")]))
    return F.filter(shown, lambda p: ~mime.is_smil(p["ct"]))


def body_text(parts: Column) -> Column:
    """Texts of the parts that are neither media nor cards, in order, a space between."""
    texts = F.filter(_filled(parts), lambda p: ~_is_card(p) & ~_is_media(p) & (null_string(p["text"]) != ""))
    return trim(F.array_join(F.transform(texts, lambda p: p["text"]), " "))


def first_media(parts: Column) -> Column:
    """The first card or media part whose data decodes, as (ct, data), or null."""
    found = F.filter(_filled(parts), lambda p: (_is_card(p) | _is_media(p)) & F.try_to_binary(p["data"], F.lit("base64")).isNotNull())
    first = F.get(found, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["ct"].alias("media_type"), F.try_to_binary(first["data"], F.lit("base64")).alias("media_data")))


def messages(raw: DataFrame, *more: str) -> DataFrame:
    """MESSAGES columns (id aside), the file, ordinal and decoded media of every
    element whose date parses, and more columns of raw."""
    kind = F.col("kind")
    found = participants(F.col("addrs"))
    own = phone.normalize(_attr("address"))
    mms_address, mms_addresses = group_address(found, _attr("address"))
    box = whole(F.when(kind == "mms", _attr("msg_box")).otherwise(_attr("type")))
    is_mms, is_call = kind == "mms", kind == "call"
    rows = raw.filter(kind.isin("sms", "mms", "call")).withColumn("date_ms", whole(_attr("date"), None)).filter("date_ms IS NOT NULL")
    rows = rows.withColumn("media", F.when(is_mms, first_media(F.col("parts"))))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    sms = lambda name: F.when(kind == "sms", whole(_attr(name))).otherwise(zero)
    mms = lambda name: F.when(is_mms, whole(_attr(name))).otherwise(zero)
    sms_text = lambda name: F.when(kind == "sms", _attr(name))
    mms_text = lambda name: F.when(is_mms, _attr(name))
    out = {
        "record_type": F.when(is_call, CALL).when(mms_text("ct_t") != "", MMS).otherwise(SMS),
        "address": F.when(is_call, phone.normalize(_attr("number"))).when(is_mms, mms_address).otherwise(own),
        "body": F.when(is_mms, body_text(F.col("parts"))).when(~is_call, _attr("body")),
        "type": box,
        "date": F.expr("date_ms div 1000"),
        "read": F.when(is_call, False).otherwise(_attr("read") == "1"),
        "thread_id": F.when(is_call, zero).otherwise(whole(_attr("thread_id"))),
        "subject": F.when(is_mms, null_string(_attr("sub"))).when(~is_call, null_string(_attr("subject"))),
        "media_type": F.coalesce(F.col("media.media_type"), F.when(~is_call, "")),
        "protocol": sms("protocol"),
        "status": sms("status"),
        "service_center": sms_text("service_center"),
        "sub_id": sms("sub_id"),
        "contact_name": _attr("contact_name"),
        "sender": F.when((box == 1) & is_mms, sender(found)).when((box == 1) & ~is_call, own).when(~is_call, ""),
        "content_type": mms_text("ct_t"),
        "read_report": mms("rr"),
        "read_status": mms("read_status"),
        "message_id": mms_text("m_id"),
        "message_size": mms("m_size"),
        "message_type": mms("m_type"),
        "sim_slot": mms("sim_slot"),
        "addresses": F.when(is_mms, mms_addresses).when(~is_call, F.when(own != "", F.array(own)).otherwise(F.array().cast("array<string>"))),
        "duration": F.when(is_call, whole(_attr("duration"))),
        "presentation": F.when(is_call, whole(_attr("presentation"))),
        "subscription_id": F.when(is_call, _attr("subscription_id")).otherwise(none),
        "content_hash": F.sha2("raw", 256),
    }
    types = {f.name: f.dataType for f in MESSAGES}
    return rows.select("file", "ordinal", *more, *[c.cast(types[n]).alias(n) for n, c in out.items()], F.col("media.media_data").alias("media_data"))
