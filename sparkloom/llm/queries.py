"""Registered queries of this subpackage and their SQL."""

from . import decontaminate, langid, license_scan, line_dedup, mixing, quality, simhash, token_counts, vafile, warc

_MODULES = {
    "op1_decontaminate": decontaminate,
    "op2_topk": vafile,
    "op3_license_scan": license_scan,
    "op4_quality": quality,
    "op5_line_dedup": line_dedup,
    "op6_simhash": simhash,
    "op7_warc": warc,
    "op8_token_counts": token_counts,
    "op9_mixing": mixing,
    "op10_language_id": langid,
}
QUERIES = {name: module.query for name, module in _MODULES.items()}
ORACLES = {name: module.ORACLE_SQL for name, module in _MODULES.items() if getattr(module, "ORACLE_SQL", None)}
