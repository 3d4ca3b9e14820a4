"""Labels and display forms of codes, times and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from missive.functions import phone

#: Labels by code: fixed values.
CALLS = {1: "Incoming call", 2: "Outgoing call", 3: "Missed call", 4: "Voicemail", 5: "Rejected call", 6: "Refused call"}
BOXES = {1: "Received", 2: "Sent", 3: "Draft", 4: "Outbox", 5: "Failed", 6: "Queued"}
STATUS = {-1: "none", 0: "complete", 32: "pending", 64: "failed"}
PRESENTATION = {1: "allowed", 2: "restricted", 3: "unknown", 4: "payphone"}


def _label(c: Column, names: dict[int, str], default: str | None) -> Column:
    out = F
    for code, name in names.items():
        out = out.when(c == code, name)
    return out.otherwise(default)


def call(c: Column, default: str | None = "Call") -> Column:
    return _label(c, CALLS, default)


def box(c: Column) -> Column:
    return _label(c, BOXES, "Message")


def status(c: Column) -> Column:
    return _label(c, STATUS, None)


def presentation(c: Column) -> Column:
    return _label(c, PRESENTATION, None)


def kind(record_type: Column) -> Column:
    return F.when(record_type == 3, "call").otherwise("message")


def duration(seconds: Column, style: str) -> Column:
    """summary: 2h 5m or 5m; activity: 45s or 2m 5s; thread: 2:05."""
    minutes = F.floor(seconds / 60)
    rest = (seconds % 60).cast("string")
    if style == "summary":
        hours = F.floor(seconds / 3600)
        left = F.floor((seconds % 3600) / 60)
        return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), left.cast("string"), F.lit("m"))).otherwise(F.concat(left.cast("string"), F.lit("m")))
    if style == "activity":
        return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(F.concat(minutes.cast("string"), F.lit("m "), rest, F.lit("s")))
    if style == "thread":
        return F.concat(minutes.cast("string"), F.lit(":"), F.lpad(rest, 2, "0"))
    raise ValueError(f"unknown style {style!r}")


def hour(c: Column) -> Column:
    return F.when(c == 0, "12 AM").when(c == 12, "12 PM").when(c < 12, F.concat(c.cast("string"), F.lit(" AM"))).otherwise(F.concat((c - 12).cast("string"), F.lit(" PM")))


def relative_date(date: Column, now: Column) -> Column:
    """Epoch seconds against a given now, by whole days between them."""
    days = F.floor((now - date) / 86400)
    at = F.timestamp_seconds(date)
    time = F.date_format(at, "h:mm a")
    same_year = F.year(at) == F.year(F.timestamp_seconds(now))
    return (
        F.when(days == 0, F.concat(F.lit("Today at "), time))
        .when(days == 1, F.concat(F.lit("Yesterday at "), time))
        .when(days < 7, F.concat(F.date_format(at, "EEEE"), F.lit(" at "), time))
        .when(same_year, F.concat(F.date_format(at, "MMM d"), F.lit(", "), time))
        .otherwise(F.concat(F.date_format(at, "MMM d, yyyy"), F.lit(", "), time))
    )


def display_name(contact: Column, subject: Column, address: Column, variant: str = "list") -> Column:
    """Subject where the contact says nothing, else the number, else the contact.
    The print variant turns away other subjects than the list does."""
    if variant == "print":
        shown = ~F.lower(subject).isin("message", "no subject")
    else:
        shown = ~subject.startswith("proto:")
    unnamed = contact.isNull() | contact.isin("", "(Unknown)")
    use_subject = subject.isNotNull() & (subject != "") & shown & (unnamed | contact.rlike(r"^[0-9]{8}$"))
    return F.when(use_subject, subject).when(unnamed, phone.format_number(address, "list")).otherwise(contact)


def sender_name(sender: Column, addresses: Column, style: str = "activity") -> Column:
    """Sender, else the first address; of a list of numbers the first."""
    given = F.coalesce(F.when(sender != "", sender), F.get(addresses, F.lit(0)))
    one = F.trim(F.get(F.split(given, ","), F.lit(0)))
    return F.when(given.isNull() | (given == ""), "Unknown").otherwise(phone.format_one(one, style))


def is_group(addresses: Column) -> Column:
    return F.coalesce(F.size(addresses) > 1, F.lit(False))


def progress_percent(processed: Column, total: Column) -> Column:
    """Whole per cent, 100 at most; a total of 0 counts as 1."""
    return F.least(F.floor(processed / F.when(total == 0, 1).otherwise(total) * 100 + 0.5), F.lit(100)).cast("int")
