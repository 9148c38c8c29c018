"""Registered queries of the subpackage, and their SQL."""

from . import chat_format, decontaminate, hamerly, html_linetext, license_scan, mixing, ngram_score, quality_crf, sentencepiece_viterbi, simhash_vptree, spelling, topk_maxscore, toxicity_cnn

QUERIES = {
    "op1_lm_scores": ngram_score.op1_lm_scores,
    "op2_near_duplicates": simhash_vptree.op2_near_duplicates,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_main_text": html_linetext.op4_main_text,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_top_k": topk_maxscore.op6_top_k,
    "op7_quality": quality_crf.op7_quality,
    "op8_toxicity": toxicity_cnn.op8_toxicity,
    "op9_sentencepiece": sentencepiece_viterbi.op9_sentencepiece,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_mixture": mixing.op11_mixture,
    "op12_clusters": hamerly.op12_clusters,
    "op13_spelling": spelling.op13_spelling,
}
ORACLE_SQL = {
    "op3_license_scan": license_scan.ORACLE_SQL,
    "op4_main_text": html_linetext.ORACLE_SQL,
    "op5_decontamination": decontaminate.ORACLE_SQL,
    "op6_top_k": topk_maxscore.ORACLE_SQL,
    "op11_mixture": mixing.ORACLE_SQL,
    "op12_clusters": hamerly.ORACLE_SQL,
    "op13_spelling": spelling.ORACLE_SQL,
}
