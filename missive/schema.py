"""Record and table schemas. Explicit everywhere; nothing is inferred."""

from pyspark.sql import types as T

SMS, MMS, CALL = 1, 2, 3

PART = "struct<seq:string,ct:string,name:string,chset:string,cl:string,text:string,data:string>"
ADDR = "struct<address:string,type:string,charset:string>"
#: One raw element of a backup file: where it stood, its bytes, and what it says.
RAW = f"file string, ordinal long, kind string, start long, stop long, raw binary, attrs map<string,string>, parts array<{PART}>, addrs array<{ADDR}>, status string"

MESSAGES = T.StructType(
    [T.StructField(n, t) for n, t in [
        ("id", T.LongType()), ("record_type", T.IntegerType()), ("address", T.StringType()), ("body", T.StringType()), ("type", T.LongType()), ("date", T.LongType()),
        ("read", T.BooleanType()), ("thread_id", T.LongType()), ("subject", T.StringType()), ("media_type", T.StringType()), ("protocol", T.LongType()), ("status", T.LongType()),
        ("service_center", T.StringType()), ("sub_id", T.LongType()), ("contact_name", T.StringType()), ("sender", T.StringType()), ("content_type", T.StringType()),
        ("read_report", T.LongType()), ("read_status", T.LongType()), ("message_id", T.StringType()), ("message_size", T.LongType()), ("message_type", T.LongType()), ("sim_slot", T.LongType()),
        ("addresses", T.ArrayType(T.StringType())), ("duration", T.LongType()), ("presentation", T.LongType()), ("subscription_id", T.StringType()), ("content_hash", T.StringType()),
    ]]
)
#: Blobs stand apart from the rows that are listed, keyed like them.
MEDIA = "content_hash string, media_type string, media_data binary"
IMPORTS = "id long, file_hash string, record_count long, chain_hash string, canon_version string, created_at timestamp"
CANON_VERSION = "h1-rawbytes-v1,h2-rawelement-v1,h3-chain-v1"

#: What makes two records the same for the store; the first wins.
DEDUP_KEY = ["record_type", "address", "date", "type", "body", "content_type", "message_id", "duration"]
