"""The queries and oracle SQL of all training-data operators."""

from __future__ import annotations

from . import binarycodes, langid, licenses, lines, media, mixing, packing, quantise, resampling, simhash, substrings, toxicity, vptree

MODULES = (simhash, toxicity, vptree, lines, substrings, media, mixing, licenses, packing, langid, resampling, binarycodes, quantise)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
