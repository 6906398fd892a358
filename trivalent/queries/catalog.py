"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trivalent.queries import books, contracts, corpus, publication, records, report_document, rules, sources, stock, structure, summaries, symbols, texts, transcription, values, work

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**rules.QUERIES, **corpus.QUERIES, **records.QUERIES, **structure.QUERIES, **transcription.QUERIES, **texts.QUERIES, **sources.QUERIES, **work.QUERIES, **publication.QUERIES, **values.QUERIES, **books.QUERIES, **contracts.QUERIES, **stock.QUERIES, **summaries.QUERIES, **symbols.QUERIES, **report_document.QUERIES}
ORACLES: dict[str, str] = {**rules.ORACLES, **corpus.ORACLES, **records.ORACLES, **structure.ORACLES, **transcription.ORACLES, **texts.ORACLES, **sources.ORACLES, **work.ORACLES, **publication.ORACLES, **values.ORACLES, **books.ORACLES, **contracts.ORACLES, **stock.ORACLES, **summaries.ORACLES, **symbols.ORACLES, **report_document.ORACLES}
