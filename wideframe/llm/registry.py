"""Queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dartminhash, decontam, quotes, urlfilter
from .bpe import op2_byte_bpe
from .dartminhash import op6_near_duplicates
from .decontam import op7_decontaminate
from .htmlmain import op5_html_main_text
from .imatch import op1_imatch
from .langid import op4_language_id
from .quotes import op10_quotation_links
from .tokencounts import op8_token_counts
from .tokenio import op9_token_files
from .urlfilter import op3_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_imatch": op1_imatch,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_url_filter": op3_url_filter,
        "op4_language_id": op4_language_id,
        "op5_html_main_text": op5_html_main_text,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_decontaminate": op7_decontaminate,
        "op8_token_counts": op8_token_counts,
        "op9_token_files": op9_token_files,
        "op10_quotation_links": op10_quotation_links,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": urlfilter.oracle_sql(),
        "op6_near_duplicates": dartminhash.ORACLE_SQL,
        "op7_decontaminate": decontam.ORACLE_SQL,
        "op10_quotation_links": quotes.ORACLE_SQL,
    }
