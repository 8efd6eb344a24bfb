"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from .conversations import OP13_SQL, op13_suffix_automaton
from .decontaminate import op1_greedy_tiling
from .embeddings import op7_cross_polytope
from .fill_middle import OP12_SQL, op12_fill_in_middle
from .language import op11_ftrl_languages
from .near_duplicates import op9_chosen_path
from .pieces import op8_piece_lattice
from .quality import op10_quality_classifier
from .repeated_windows import op2_super_kmers
from .secrets import op3_secret_field
from .suffix_arrays import op5_suffix_blocks
from .suffix_tree import op4_suffix_tree
from .token_counts import op6_section_tokens

QUERIES = {f.__name__: f for f in (
    op1_greedy_tiling, op2_super_kmers, op3_secret_field, op4_suffix_tree, op5_suffix_blocks, op6_section_tokens, op7_cross_polytope, op8_piece_lattice, op9_chosen_path, op10_quality_classifier,
    op11_ftrl_languages, op12_fill_in_middle, op13_suffix_automaton,
)}

SQL: dict[str, str] = {"op12_fill_in_middle": OP12_SQL, "op13_suffix_automaton": OP13_SQL}
