"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinscope.llm import alignment, bpe, click_windows, langid, media, mixing, multi_index, near_dups, packed, quality, toxicity, vector_dups, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_multi_index": multi_index.op2_multi_index,
    "op3_bpe": bpe.op3_bpe,
    "op4_langid": langid.op4_langid,
    "op5_quality": quality.op5_quality,
    "op6_near_dups": near_dups.op6_near_dups,
    "op7_warc": warc.op7_warc,
    "op8_mixing": mixing.op8_mixing,
    "op9_packed": packed.op9_packed,
    "op10_media": media.op10_media,
    "op11_alignment": alignment.op11_alignment,
    "op12_click_windows": click_windows.op12_click_windows,
    "op13_vector_dups": vector_dups.op13_vector_dups,
}

ORACLE_SQL: dict[str, str] = {
    "op7_warc": warc.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
}
