"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from loomstat.llm import fingerprints, katz, neighbours, packing, pieces, quality, secrets, simhash, urls, warc

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_urls": urls.query,
    "op3_quality": quality.query,
    "op4_warc": warc.query,
    "op5_sentencepiece": pieces.query,
    "op6_packing": packing.query,
    "op7_katz": katz.query,
    "op8_fingerprints": fingerprints.query,
    "op9_secrets": secrets.query,
    "op10_neighbours": neighbours.query,
}

ORACLES: dict[str, str] = {"op4_warc": warc.ORACLE}
