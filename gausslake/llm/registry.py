"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import licenses, repeats
from .decontaminate import op7_decontamination
from .licenses import op4_licenses
from .neighbours import op5_neighbours
from .packing import op8_packing
from .pages import op2_main_text
from .paragraphs import op3_paragraphs
from .quality import op9_quality
from .repeats import op6_repeats
from .simhash import op1_simhash
from .tokens import op10_token_counts

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_main_text": op2_main_text,
    "op3_paragraphs": op3_paragraphs,
    "op4_licenses": op4_licenses,
    "op5_neighbours": op5_neighbours,
    "op6_repeats": op6_repeats,
    "op7_decontamination": op7_decontamination,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_token_counts": op10_token_counts,
}

#: The others rest on hashes, fits, cuts or libraries that SQL has not; tests compare them with brute force.
ORACLES: dict[str, str] = {"op4_licenses": licenses.oracle(), "op6_repeats": repeats.oracle()}
