"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from slideqa.llm.bpe import op6_bpe
from slideqa.llm.class_lm import op8_class_lm
from slideqa.llm.decontaminate import OP1_SQL, op1_decontaminate
from slideqa.llm.filter_audit import OP11_SQL, op11_filter_audit
from slideqa.llm.licenses import OP10_SQL, op10_licenses
from slideqa.llm.near_dup import OP2_SQL, op2_near_dup
from slideqa.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from slideqa.llm.quality import op4_quality
from slideqa.llm.quality_net import op12_quality_net
from slideqa.llm.secrets import op5_secrets
from slideqa.llm.token_file import op9_token_file
from slideqa.llm.url_filter import OP3_SQL, op3_url_filter
from slideqa.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_near_dup": op2_near_dup,
    "op3_url_filter": op3_url_filter,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_bpe": op6_bpe,
    "op7_warc": op7_warc,
    "op8_class_lm": op8_class_lm,
    "op9_token_file": op9_token_file,
    "op10_licenses": op10_licenses,
    "op11_filter_audit": op11_filter_audit,
    "op12_quality_net": op12_quality_net,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_decontaminate": OP1_SQL,
    "op2_near_dup": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op7_warc": OP7_SQL,
    "op10_licenses": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
