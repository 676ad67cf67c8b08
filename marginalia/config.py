"""Parameters of the retrieval pipeline, with the defaults of the blueprint."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 1024
    overlap: int = 256
    separators: tuple[str, ...] = ("\n\n", "\n", " ", "")

    def __post_init__(self):
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be at least 0 and below size")


@dataclass(frozen=True)
class EmbedConfig:
    dim: int = 1024
    max_tokens: int = 512
    batch_size: int = 128


@dataclass(frozen=True)
class CollectionConfig:
    name: str = "collection"
    dim: int = 1024
    distance: str = "cosine"
    rebuild: bool = True
    upload_multiplier: int = 250
    wire_batch: int = 256
    #: Ids that share a partition of the stored table; only partitions that an upsert touches are written again.
    part_ids: int = 1 << 20


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 5
    overfetch_k: int = 5
    exact_below_bytes: int = 10_000 * 1024
    #: Cells of the index (None: the square root of the points, 16 at least), and those that a question visits
    #: (None: as many as a sample needs for this recall).
    nlist: int | None = None
    nprobe: int | None = None
    recall: float = 0.97


@dataclass(frozen=True)
class Config:
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    embed: EmbedConfig = field(default_factory=EmbedConfig)
    collection: CollectionConfig = field(default_factory=CollectionConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
