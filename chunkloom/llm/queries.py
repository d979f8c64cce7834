"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm.ann import op6_ann
from chunkloom.llm.bpe import op2_bpe
from chunkloom.llm.embed_dedup import op3_embed_dedup
from chunkloom.llm.html_main import op5_html
from chunkloom.llm.langid import op1_language
from chunkloom.llm.licenses import op7_licenses
from chunkloom.llm.mixing import op4_mixing
from chunkloom.llm.ngram_join import op9_ngram_join
from chunkloom.llm.oracles import ORACLES
from chunkloom.llm.quality import op8_quality
from chunkloom.llm.secrets import op10_secrets


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (op1_language, op2_bpe, op3_embed_dedup, op4_mixing, op5_html, op6_ann, op7_licenses, op8_quality, op9_ngram_join, op10_secrets)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
