"""The queries of this subpackage and their DuckDB SQL, by name."""

from .bpe import op9_byte_bpe
from .collocations import OP11_SQL, op11_collocations
from .conversation_trie import OP12_SQL, op12_conversation_trie
from .decontaminate import OP3_SQL, op3_decontamination
from .language_id import op6_language_id
from .line_dedup import OP2_SQL, op2_line_dedup
from .ngram_join import OP10_SQL, op10_ngram_join
from .spotsigs import op4_spotsigs
from .substring_dedup import op5_substring_dedup
from .token_records import op8_token_records
from .toxicity import op1_toxicity
from .url_filter import op7_url_filter
from .warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_spotsigs": op4_spotsigs,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_url_filter": op7_url_filter,
    "op8_token_records": op8_token_records,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_ngram_join": op10_ngram_join,
    "op11_collocations": op11_collocations,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_warc": op13_warc,
}
ORACLE_SQL = {"op2_line_dedup": OP2_SQL, "op3_decontamination": OP3_SQL, "op10_ngram_join": OP10_SQL, "op11_collocations": OP11_SQL, "op12_conversation_trie": OP12_SQL, "op13_warc": OP13_SQL}
