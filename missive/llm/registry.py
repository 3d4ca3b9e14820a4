"""Queries of the corpus operators and their SQL, by the name under which they are registered."""

from missive.llm import bpe, decontamination, fingerprint, langid, licenses, linededup, minhash, ngramlm, periodic, pii, quality, sharding, whitening

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_quality": quality.op2_quality,
    "op3_bpe": bpe.op3_bpe,
    "op4_pii": pii.op4_pii,
    "op5_fingerprint": fingerprint.op5_fingerprint,
    "op6_langid": langid.op6_langid,
    "op7_licenses": licenses.op7_licenses,
    "op8_minhash": minhash.op8_minhash,
    "op9_linededup": linededup.op9_linededup,
    "op10_ngramlm": ngramlm.op10_ngramlm,
    "op11_whitening": whitening.op11_whitening,
    "op12_periodic": periodic.op12_periodic,
    "op13_sharding": sharding.op13_sharding,
}

ORACLE_SQL = {
    "op1_decontamination": decontamination.OP1_SQL,
    "op8_minhash": minhash.OP8_SQL,
}
