"""The queries of this subpackage for ``__spark_entry__``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import common

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, written as shards and read back."""
    from .token_planes import token_planes

    return token_planes(common.documents(spark, sf_dir), BYTE_BPE)


def queries() -> dict:
    from .chat_format import op3_chat_format
    from .license_scan import op4_license_scan
    from .decontaminate import op10_decontaminate
    from .media import op7_media_jpeg
    from .mixing import op9_mixing
    from .quality_cnn import op5_quality_cnn
    from .token_counts import op6_token_counts
    from .url_rules import op8_url_rules
    from .simhash import op2_simhash

    return {
        "op1_token_planes": op1_token_planes,
        "op2_simhash": op2_simhash,
        "op3_chat_format": op3_chat_format,
        "op4_license_scan": op4_license_scan,
        "op5_quality_cnn": op5_quality_cnn,
        "op6_token_counts": op6_token_counts,
        "op7_media_jpeg": op7_media_jpeg,
        "op8_url_rules": op8_url_rules,
        "op9_mixing": op9_mixing,
        "op10_decontaminate": op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    from . import chat_format, decontaminate, license_scan, url_rules

    return {"op3_chat_format": chat_format.ORACLE, "op4_license_scan": license_scan.oracle(), "op8_url_rules": url_rules.ORACLE, "op10_decontaminate": decontaminate.ORACLE}
