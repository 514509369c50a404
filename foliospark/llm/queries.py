"""The queries of this subpackage's operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontaminate, filter_audit, fim, hilbert, html_text, language, mixture, quality, secrets, simhash, sketch, url_filter, warc
from foliospark.llm.common import table


def _on(name: str, op: Callable[..., DataFrame], *others: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(table(spark, sf_dir, name), *(table(spark, sf_dir, x) for x in others))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixture": _on("documents", mixture.op1),
    "op2_secrets": _on("documents", secrets.op2),
    "op3_sketch": _on("documents", sketch.op3),
    "op4_quality": _on("documents", quality.op4, "labels"),
    "op5_html_text": _on("pages", html_text.op5),
    "op6_simhash": _on("documents", simhash.op6),
    "op7_hilbert": _on("documents", hilbert.op7),
    "op8_url_filter": _on("pages", url_filter.op8),
    "op9_warc": _on("pages", warc.op9),
    "op10_decontaminate": _on("documents", decontaminate.op10, "benchmark"),
    "op11_language": _on("documents", language.op11),
    "op12_fim": _on("documents", fim.op12),
    "op13_filter_audit": _on("documents", filter_audit.op13, "labels"),
}

ORACLES: dict[str, str] = {
    "op1_mixture": mixture.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
    "op12_fim": fim.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
