"""Registered queries of the llm operators, with the SQL that checks them."""

from __future__ import annotations

from inkspark.llm import neardup, packing, personal, splitting, subjects, tokens

QUERIES = {
    "p1_found": splitting.found,
    "p1_pieces": splitting.note_pieces,
    "p2_found": personal.found,
    "p2_redacted": personal.redacted,
    "p3_found": neardup.found,
    "p3_classes": neardup.classes,
    "p3_similar": neardup.similar,
    "p4_doc_tokens": tokens.document_tokens,
    "p4_slices": tokens.slices,
    "p7_packed": packing.packed,
    "p7_containers": packing.containers,
    "p8_found": subjects.found,
    "p8_composition": subjects.composition,
    "p6_ids": tokens.corpus_ids,
    "p6_decoded": tokens.decoded_lengths,
}
SQL: dict[str, str] = {
    "p1_found": """
        select distinct note_id from notes join embedding_config using (config_id)
        where note_id is not null and len(regexp_extract_all(content, '[^ \\t\\r\\n]+')) * 13 // 10 > chunk_size""",
    "p6_decoded": "select doc_id, coalesce(length(text), 0)::bigint as n_chars, sha256(coalesce(text, '')) as text_hash from documents where doc_id is not null",
}
