"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from signalmill.llm import chat, collocation, decontam, html, importance, lattice, linedup, mixing, quality, sigtree, suffix, toxicity, warc


def queries() -> dict:
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_suffix_dedup": suffix.op2_suffix_dedup,
        "op3_lattice_dedup": lattice.op3_lattice_dedup,
        "op4_warc": warc.op4_warc,
        "op5_ngram_jaccard": sigtree.op5_ngram_jaccard,
        "op6_decontam": decontam.op6_decontam,
        "op7_html_text": html.op7_html_text,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_mixing": mixing.op9_mixing,
        "op10_quality": quality.op10_quality,
        "op11_importance": importance.op11_importance,
        "op12_line_dedup": linedup.op12_line_dedup,
        "op13_collocations": collocation.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.OP4_SQL, "op6_decontam": decontam.OP6_SQL, "op9_mixing": mixing.OP9_SQL, "op11_importance": importance.OP11_SQL, "op12_line_dedup": linedup.OP12_SQL, "op13_collocations": collocation.OP13_SQL}
