"""Schemas of the landed tables and the exact-match contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the archive's tables, in order (fixed values).
DDL = {
    "contact": "id long, username string, local_type long, alias string, encrypt_username string, flag long, delete_flag long, verify_flag long, remark string, remark_quan_pin string, remark_pin_yin_initial string, nick_name string, pin_yin_initial string, quan_pin string, big_head_url string, small_head_url string, head_img_md5 string, chat_room_notify long, is_in_chat_room long, description string, extra_buffer binary, chat_room_type long",
    "message_names": "shard_number int, row_id long, user_name string, is_session long",
    "messages": "shard_number int, conversation_username string, table_name string, local_id long, server_id long, local_type long, sort_seq long, real_sender_id long, create_time long, status long, upload_status long, download_status long, server_seq long, origin_source long, source string, message_content string, compress_content string, packed_info_data binary, WCDB_CT_message_content long, WCDB_CT_source long",
    "media_names": "row_id long, user_name string",
    "voice_heads": "row_id long, chat_name_id long, create_time long, local_id long, svr_id long, payload_length long, payload_prefix binary, payload_sha256 string",
    "voice_info": "row_id long, chat_name_id long, create_time long, local_id long, svr_id long, voice_data binary, data_index string",
}


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(DDL[name])


def voice_heads(voice_info: DataFrame) -> DataFrame:
    """Of each payload its length, first bytes and hash: what scans need, landed beside the payloads."""
    payload = F.col("voice_data")
    return voice_info.select("row_id", "chat_name_id", "create_time", "local_id", "svr_id", F.octet_length(payload).cast("long").alias("payload_length"), F.substring(payload, 1, 10).alias("payload_prefix"), F.sha2(payload, 256).alias("payload_sha256"))


class UnsupportedSchema(ValueError):
    pass


def require_schema(df: DataFrame, name: str) -> DataFrame:
    """The frame itself if its columns equal the contract's, name by name and type by type, in order."""
    expected, found = [(f.name, f.dataType) for f in schema(name)], [(f.name, f.dataType) for f in df.schema]
    if expected != found:
        wrong = [f"{a} is not {b}" for a, b in zip(found, expected) if a != b] or [f"{len(found)} columns are not {len(expected)}"]
        raise UnsupportedSchema(f"{name}: {wrong[0]}")
    return df
