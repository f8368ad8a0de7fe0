"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bpe import op4_bpe
from .decontamination import OP10_SQL, op10_decontamination
from .html_text import op8_html_text
from .lattice_links import OP12_SQL, op12_lattice_links
from .line_dedup import OP7_SQL, op7_line_dedup
from .near_dedup import op5_near_duplicates
from .neighbours import op3_neighbours
from .periodic_runs import op11_periodic_runs
from .revisits import OP9_SQL, op9_revisits
from .spelling import op13_spelling_variants
from .substring_dedup import op6_substring_dedup
from .token_counts import op2_token_counts
from .toxicity import op1_toxicity


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_neighbours, op4_bpe, op5_near_duplicates, op6_substring_dedup, op7_line_dedup, op8_html_text, op9_revisits, op10_decontamination, op11_periodic_runs, op12_lattice_links, op13_spelling_variants)}


def oracle_sql() -> dict:
    return {"op9_revisits": OP9_SQL, "op7_line_dedup": OP7_SQL, "op10_decontamination": OP10_SQL, "op12_lattice_links": OP12_SQL}
