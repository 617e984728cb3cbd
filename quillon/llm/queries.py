"""The queries of this subpackage and their SQL."""

from quillon.llm import embeddings, exact_dedup, fim, licenses, merkle, mixing, packing, quality, simhash, substrings, tokenfile, tokens, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_simhash": simhash.op2_simhash,
    "op3_mixing": mixing.op3_mixing,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_embedding_dedup": embeddings.op5_embedding_dedup,
    "op6_quality": quality.op6_quality,
    "op7_packing": packing.op7_packing,
    "op8_licenses": licenses.op8_licenses,
    "op9_warc": warc.op9_warc,
    "op10_substrings": substrings.op10_substrings,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_token_files": tokenfile.op12_token_files,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op3_mixing": mixing.SQL,
    "op5_embedding_dedup": embeddings.SQL,
    "op9_warc": warc.SQL,
    "op10_substrings": substrings.SQL,
    "op11_fill_in_middle": fim.SQL,
    "op13_merkle": merkle.SQL,
}
