"""The queries of this subpackage, and the SQL of those that SQL can express on whole tables."""

from .covertree import OP10_SQL, op10_embeddings
from .exact import OP3_SQL, op3_exact_dedup
from .lines import op6_lines
from .mixing import OP4_SQL, op4_mixing
from .pieces import op5_sentencepiece
from .scoring import op2_lm_scoring
from .secrets import op9_secrets
from .simhash import op8_simhash
from .suffixes import OP7_SQL, op7_substrings
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mixing": op4_mixing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_lines": op6_lines,
    "op7_substrings": op7_substrings,
    "op8_simhash": op8_simhash,
    "op9_secrets": op9_secrets,
    "op10_embeddings": op10_embeddings,
}
ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op4_mixing": OP4_SQL, "op7_substrings": OP7_SQL, "op10_embeddings": OP10_SQL}
