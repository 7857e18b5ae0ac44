"""The queries of this subpackage and the SQL that states them."""

from __future__ import annotations

from . import extraction, matroska, mixing, nearby, neighbours, pieces, quality, substrings, toxicity, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_extraction": extraction.op2_extraction,
    "op3_warc": warc.op3_warc,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_substrings": substrings.op5_substrings,
    "op6_mixing": mixing.op6_mixing,
    "op7_matroska": matroska.op7_matroska,
    "op8_pieces": pieces.op8_pieces,
    "op9_nearby": nearby.op9_nearby,
    "op10_neighbours": neighbours.op10_neighbours,
}
ORACLE_SQL = {
    "op2_extraction": extraction.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op5_substrings": substrings.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
}
