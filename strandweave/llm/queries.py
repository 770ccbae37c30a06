"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from strandweave.llm import ann, ballkmeans, bpe, ego, htmltext, langid, packing, prefixtrie, quality, rules, simhash, simple8b, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_packing": packing.query,
    "op3_bpe": bpe.query,
    "op4_ann": ann.query,
    "op5_simhash": simhash.query,
    "op6_quality": quality.query,
    "op7_langid": langid.query,
    "op8_htmltext": htmltext.query,
    "op9_ego": ego.query,
    "op10_simple8b": simple8b.query,
    "op11_prefixtrie": prefixtrie.query,
    "op12_rules": rules.query,
    "op13_ballkmeans": ballkmeans.query,
}

ORACLE_SQL = {"op1_warc": warc.ORACLE_SQL, "op9_ego": ego.ORACLE_SQL, "op11_prefixtrie": prefixtrie.ORACLE_SQL, "op13_ballkmeans": ballkmeans.ORACLE_SQL}
