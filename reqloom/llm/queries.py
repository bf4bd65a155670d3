"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from . import bpe, embeddings, minhash, mixing, secrets, simhash, suffixdedup, toxicity, urlfilter, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_minhash": minhash.op2_minhash,
    "op3_secrets": secrets.op3_secrets,
    "op4_embeddings": embeddings.op4_embeddings,
    "op5_warc": warc.op5_warc,
    "op6_simhash": simhash.op6_simhash,
    "op7_urlfilter": urlfilter.op7_urlfilter,
    "op8_mixing": mixing.op8_mixing,
    "op9_suffixdedup": suffixdedup.op9_suffixdedup,
    "op10_toxicity": toxicity.op10_toxicity,
}
SQL = {"op3_secrets": secrets.sql(), "op5_warc": warc.sql(), "op7_urlfilter": urlfilter.sql(), "op8_mixing": mixing.sql()}
