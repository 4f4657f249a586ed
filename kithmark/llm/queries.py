"""Registry of the corpus operators' queries and, where SQL can say it, their SQL."""

from __future__ import annotations

from . import byte_bpe, chat, divergence, exact_dedup, filter_audit, langid, line_dedup, mih, mixing, piece_codec, secret_ledger, simhash, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1,
    "op2_mixing": mixing.op2,
    "op3_chat_formatting": chat.op3,
    "op4_secret_scan": secret_ledger.op4,
    "op5_simhash": simhash.op5,
    "op6_warc": warc.op6,
    "op7_line_dedup": line_dedup.op7,
    "op8_topk_search": mih.op8,
    "op9_sentencepiece": piece_codec.op9,
    "op10_language_id": langid.op10,
    "op11_source_divergence": divergence.op11,
    "op12_filter_interaction": filter_audit.op12,
    "op13_byte_bpe": byte_bpe.op13,
    "site_lines": line_dedup.site_lines,
}

SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op3_chat_formatting": chat.OP3_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op8_topk_search": mih.OP8_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op12_filter_interaction": filter_audit.OP12_SQL,
    "site_lines": line_dedup.SITE_SQL,
}
