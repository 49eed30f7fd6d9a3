"""Settings that are part of the results. All are fixed values unless a caller passes others."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 500
    chunk_overlap: int = 80
    #: Characters of a text that are chunked, all if None. The reference takes 20,000.
    max_content: int | None = None
    embed_max: int = 600
    score_threshold: float = 0.35
    sparse_top_k: int = 120
    dense_top_k: int = 120
    fusion_top_k: int = 200
    rerank_top_n: int = 50
    rerank_max_chars: int = 2000
    rrf_k: int = 60
    missing_rank: int = 1000
    default_limit: int = 50
    most_results: int = 200
    chars_per_token: float = 1.5
    chunks_per_file: float = 4.0
    seconds_per_file: float = 0.35
    #: BM25 weights of the indexed fields.
    field_weights: tuple[tuple[str, float], ...] = (("filename", 8.0), ("path", 3.0), ("heading", 4.0), ("content", 1.0))
    #: Parts of the best three chunks in a file's score, and the bonuses.
    ranks: tuple[float, float, float] = (0.70, 0.15, 0.05)
    filename_bonus: float = 0.10
    heading_bonus: float = 0.05
    exact_bonus: float = 0.10
    multi_hit_bonus: float = 0.05
    recency_bonus: float = 0.05
    half_life_days: float = 7.0
    #: The time that recency counts from. A parameter, so that results don't depend on the clock.
    now_ts: float = 1_735_689_600.0


SETTINGS = Settings()

#: Budgets and fusion weights by query type: sparse_k, dense_k, weight of sparse ranks, weight of dense ranks.
QUERY_TYPES = {
    "exact": (180, 36, 1.4, 0.7),
    "semantic": (84, 180, 0.8, 1.2),
    "filename": (240, 24, 1.3, 0.5),
    "code": (180, 96, 1.2, 0.8),
    "hybrid": (120, 120, 1.0, 1.0),
}

#: File extensions by class.
TEXT_EXTENSIONS = ".txt .md .py .js .json .html .css .c .cpp .h .java .go .ts .vue .sql .sh .yaml .xml .csv .log .ini .cfg .toml .rst .r .rb .php".split()
OFFICE_EXTENSIONS = ".pdf .docx .xlsx .pptx".split()
MEDIA_EXTENSIONS = ".key .jpg .jpeg .png .gif .bmp .svg .webp .mp4 .mov .avi .mkv .mp3 .wav .m4a .tiff .heic .flac .aac .ogg .wmv .zip .rar .7z .dmg .iso .exe .app .sketch .fig .psd .ai".split()
