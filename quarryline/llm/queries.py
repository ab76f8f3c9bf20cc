"""The queries of this subpackage, by name, and their SQL."""

from . import op1_topk, op2_pack, op3_jaccard, op4_quality, op5_pii, op6_licenses, op7_passages, op8_toxicity, op9_decontaminate, op10_urls, op11_mix, op12_fim, op13_resample

QUERIES = {
    "op1_topk": op1_topk.op1_topk,
    "op2_pack": op2_pack.op2_pack,
    "op3_jaccard": op3_jaccard.op3_jaccard,
    "op4_quality": op4_quality.op4_quality,
    "op5_pii": op5_pii.op5_pii,
    "op6_licenses": op6_licenses.op6_licenses,
    "op7_passages": op7_passages.op7_passages,
    "op8_toxicity": op8_toxicity.op8_toxicity,
    "op9_decontaminate": op9_decontaminate.op9_decontaminate,
    "op10_urls": op10_urls.op10_urls,
    "op11_mix": op11_mix.op11_mix,
    "op12_fim": op12_fim.op12_fim,
    "op13_resample": op13_resample.op13_resample,
}
SQL = {
    "op1_topk": op1_topk.SQL,
    "op7_passages": op7_passages.SQL,
    "op9_decontaminate": op9_decontaminate.SQL,
    "op10_urls": op10_urls.SQL,
    "op11_mix": op11_mix.SQL,
    "op12_fim": op12_fim.SQL,
    "op13_resample": op13_resample.SQL,
}
