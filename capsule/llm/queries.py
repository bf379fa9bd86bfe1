"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from capsule.llm import alignment, bpe, classifier, fingerprints, jaccard, language, lexical, licenses, mixing, rules, secrets, sql, superminhash, warc

QUERIES = {
    "op1_warc_segments": warc.op1_warc_segments,
    "op2_weighted_mixing": mixing.op2_weighted_mixing,
    "op3_language_id": language.op3_language_id,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_syncmer_fingerprints": fingerprints.op5_syncmer_fingerprints,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_quality_classifier": classifier.op10_quality_classifier,
    "op11_superminhash": superminhash.op11_superminhash,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_token_alignment": alignment.op13_token_alignment,
}

#: The others hash words or keys, learn weights or merge tokens; tests compare them with plain versions.
SQL = {
    "op1_warc_segments": sql.ARCHIVES,
    "op4_secret_scan": sql.SECRETS,
    "op8_ngram_jaccard": sql.CLASSES,
    "op11_superminhash": sql.NEAR,
    "op12_lexical_search": sql.RANKED,
}
