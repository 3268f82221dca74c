"""The queries of the training-data operators, and their SQL where it can express them."""

from .bpe import op2_bpe
from .centroids import OP12_SQL, op12_sort_means
from .exact_dedup import OP11_SQL, op11_exact_dedup
from .html_extract import op9_html
from .language_id import op5_language
from .media import op4_media
from .merkle import OP13_SQL, op13_merkle
from .minhash import op3_minhash
from .mixing import OP6_SQL, op6_mixing
from .pitman_yor import op8_pitman_yor
from .quality import op10_quality
from .secrets import op7_secrets
from .suffix_dedup import op1_suffix_dedup

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_bpe, op3_minhash, op4_media, op5_language, op6_mixing, op7_secrets, op8_pitman_yor, op9_html, op10_quality, op11_exact_dedup, op12_sort_means, op13_merkle)}
ORACLE_SQL = {"op6_mixing": OP6_SQL, "op11_exact_dedup": OP11_SQL, "op12_sort_means": OP12_SQL, "op13_merkle": OP13_SQL}
