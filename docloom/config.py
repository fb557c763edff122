"""Tunables of ingestion and retrieval; every field can be set by the environment variable of its upper-case name."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


#: The defaults that users know, by the names they set them by.
@dataclass(frozen=True)
class Settings:
    semantic_similarity_threshold: float = 0.72
    semantic_min_sentences: int = 2
    semantic_max_characters: int = 3500
    rrf_k: int = 60
    search_rrf_threshold: float = 0.012
    broad_search_top_k: int = 20
    source_selection_ratio: float = 0.6
    enable_pdf_ocr: bool = False
    enable_structured_retrieval: bool = True
    structure_score_threshold: int = 8
    structured_max_sections: int = 6
    dense_vector_size: int = 1024
    table_rows_per_segment: int = 20
    catalog_characters: int = 24_000
    zip_members: int = 1_000
    zip_bytes: int = 500 * 1024 * 1024
    max_images_per_table: int = 6

    @classmethod
    def from_env(cls) -> Settings:
        given = {}
        for field in fields(cls):
            raw = os.environ.get(field.name.upper())
            if raw is not None:
                kind = type(field.default)
                given[field.name] = raw.strip().lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        return cls(**given)


DEFAULTS = Settings()

#: Fixed values shared with stored payloads.
DEFAULT_SECTION = "Document body"
HYBRID_MODE = "hybrid_vector"
TREE_MODE = "vectorless_structured_tree"
ARCHIVE_SUFFIXES = (".zip",)
SUPPORTED_SUFFIXES = (".docx", ".pdf", ".txt", ".xlsm", ".xlsx")
NO_PASSAGES = "I could not find any relevant passages in the indexed documents to answer your question."
NO_MODEL = "*(No LLM API key configured — showing the best-matching passage as the answer.)*\n\n"

#: Okapi constants of the sparse encoder: a fixed mean length keeps a document's weights independent of the others.
BM25_K, BM25_B, BM25_MEAN_LENGTH = 1.2, 0.75, 256.0
