"""The queries of the training-data operators, opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from .hilbert import op5_hilbert
from .htmltext import op6_htmltext
from .lattice import op2_lattice
from .mixing import op10_mixing
from .packing import op1_packing
from .simhash import op4_simhash
from .syncmers import op7_syncmers
from .tokens import op9_tokens
from .toxicity import op8_toxicity
from .urls import ORACLE as URLS_SQL
from .urls import op3_urls

QUERIES: dict[str, Callable] = {
    "op1_packing": op1_packing,
    "op2_lattice": op2_lattice,
    "op3_urls": op3_urls,
    "op4_simhash": op4_simhash,
    "op5_hilbert": op5_hilbert,
    "op6_htmltext": op6_htmltext,
    "op7_syncmers": op7_syncmers,
    "op8_toxicity": op8_toxicity,
    "op9_tokens": op9_tokens,
    "op10_mixing": op10_mixing,
}

ORACLE: dict[str, str] = {"op3_urls": URLS_SQL}
