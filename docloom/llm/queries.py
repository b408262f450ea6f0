"""The queries of the training-data operators and their SQL, for __spark_entry__.py."""

from docloom.llm import bpe, exact_dedup, html_extract, language_id, line_dedup, lm_scoring, near_dedup, nearest, packing, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_minhash_near_dedup": near_dedup.op2_minhash_near_dedup,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_packing": packing.op5_packing,
    "op6_warc": warc.op6_warc,
    "op7_language_id": language_id.op7_language_id,
    "op8_bpe": bpe.op8_bpe,
    "op9_html_extraction": html_extract.op9_html_extraction,
    "op10_nearest_neighbours": nearest.op10_nearest_neighbours,
}

SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op6_warc": warc.SQL,
    "op10_nearest_neighbours": nearest.SQL,
}
