"""The queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from readloom.llm import decontaminate, langid, lcp, lm, resample, secrets, sentencepiece_codec, simhash, tokenfile, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_langid": langid.query,
    "op3_secrets": secrets.query,
    "op4_toxicity": toxicity.query,
    "op5_resample": resample.query,
    "op6_tokenfile": tokenfile.query,
    "op7_sentencepiece": sentencepiece_codec.query,
    "op8_lm": lm.query,
    "op9_lcp": lcp.query,
    "op10_simhash": simhash.query,
}

#: Only what SQL can express; the others are tested against brute-force versions.
SQL = {
    "op1_decontaminate": decontaminate.SQL,
}
