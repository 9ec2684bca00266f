"""The queries of this subpackage and, where SQL can express them, their SQL."""

from ripplet.llm.bpe import op4_byte_bpe
from ripplet.llm.decontam import ORACLE as DECONTAM_SQL
from ripplet.llm.decontam import op5_decontamination
from ripplet.llm.embed_dedup import ORACLE as EMBED_SQL
from ripplet.llm.embed_dedup import op8_embedding_dedup
from ripplet.llm.html_text import op6_html_text
from ripplet.llm.langid import op10_language_id
from ripplet.llm.licences import op2_licence_scan
from ripplet.llm.minhash import ORACLE as MINHASH_SQL
from ripplet.llm.minhash import op7_minhash_dedup
from ripplet.llm.passages import op9_substring_dedup
from ripplet.llm.url_filter import ORACLE as URL_SQL
from ripplet.llm.url_filter import op1_url_filter
from ripplet.llm.warc import ORACLE as WARC_SQL
from ripplet.llm.warc import op3_warc

QUERIES = {
    "op4_byte_bpe": op4_byte_bpe,
    "op5_decontamination": op5_decontamination,
    "op6_html_text": op6_html_text,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language_id": op10_language_id,
    "op1_url_filter": op1_url_filter,
    "op2_licence_scan": op2_licence_scan,
    "op3_warc": op3_warc,
}

ORACLES = {
    "op5_decontamination": DECONTAM_SQL,
    "op7_minhash_dedup": MINHASH_SQL,
    "op8_embedding_dedup": EMBED_SQL,
    "op1_url_filter": URL_SQL,
    "op3_warc": WARC_SQL,
}
