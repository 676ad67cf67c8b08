"""SQL that says what the queries return, put together from shared parts."""

from __future__ import annotations

from ..functions.text import WHITE
from ..operators.answer import INSTRUCTION

_CHUNKS = rf"""
WITH windows AS (
  SELECT doc_id, source, i, regexp_replace(substr(text, i * 768 + 1, 1024), '^{WHITE}+|{WHITE}+$', '', 'g') AS text
  FROM (SELECT *, unnest(range(0, ceil(greatest(length(text) - 1024, 0) / 768.0)::BIGINT + 1)) AS i FROM documents)),
chunks AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_idx, text FROM windows WHERE text <> ''),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_idx) - 1 AS id FROM chunks)"""

_WORDS = r"[w for w in regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+') if w <> '']"

TRUNCATED = (
    "SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens, n_chars FROM "
    f"(SELECT doc_id, list_slice({_WORDS.format('text')}, 1, 512) AS t, length(text)::BIGINT AS n_chars FROM documents)"
)


def _bag(name: str, table: str, key: str, text: str) -> str:
    return (
        f"{name} AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 1024 AS bucket, count(*)::BIGINT AS n FROM "
        f"(SELECT {key}, unnest(list_slice({_WORDS.format(text)}, 1, 512)) AS w FROM {table}) GROUP BY 1, 2)"
    )


_EMBEDDINGS = (
    f"{_CHUNKS},\n{_bag('embedded', 'numbered', 'id', 'text')},\n"
    f"questions AS (SELECT item_id AS query_id, text AS query FROM benchmark),\n{_bag('asked', 'questions', 'query_id', 'query')}"
)

_HITS = (
    _EMBEDDINGS
    + """,
scored AS (
  SELECT a.query_id, e.id, sum(a.n * e.n)::DOUBLE / sqrt((any_value(x.s) * any_value(y.s))::DOUBLE) AS score
  FROM asked a JOIN embedded e USING (bucket)
  JOIN (SELECT query_id, sum(n * n) AS s FROM asked GROUP BY 1) x ON x.query_id = a.query_id
  JOIN (SELECT id, sum(n * n) AS s FROM embedded GROUP BY 1) y ON y.id = e.id
  GROUP BY a.query_id, e.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored),
hits AS (SELECT r.query_id, r.rank, r.id, r.score, c.text, c.source FROM ranked r JOIN numbered c USING (id) WHERE r.rank <= 5)"""
)

_CONTEXTS = (
    _HITS
    + r""",
contexts AS (
  SELECT q.query_id, q.query, count(h.rank)::BIGINT AS n_documents, string_agg(h.source, ',' ORDER BY h.rank) AS sources,
    coalesce(string_agg('[Document ' || h.rank || ' - ' || coalesce(h.source, 'unknown') || ']' || chr(10) || h.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY h.rank), '') AS context,
    min(h.text) FILTER (WHERE h.rank = 1) AS best
  FROM questions q LEFT JOIN hits h USING (query_id) GROUP BY q.query_id, q.query),
prompts AS (SELECT *, concat_ws(chr(10), '"""
    + INSTRUCTION.replace("'", "''")
    + r"""', 'Documents:', context, 'Question: ' || query, 'Answer:') AS prompt FROM contexts),
answers AS (SELECT *, CASE WHEN regexp_extract(best, '(?s)^.*?[.!?]') = '' THEN best ELSE regexp_extract(best, '(?s)^.*?[.!?]') END AS answer FROM prompts)
"""
)


def with_chunks(select: str) -> str:
    return f"{_CHUNKS}\n{select}"


def with_embeddings(select: str) -> str:
    return f"{_EMBEDDINGS}\n{select}"


def with_hits(select: str) -> str:
    return f"{_HITS}\n{select}"


def with_contexts(select: str) -> str:
    return f"{_CONTEXTS}\n{select}"


def _measure(a: str, b: str, distance: str) -> str:
    each = "[{0} for i in range(1, len(" + a + ") + 1)]"
    x, y = f"{a}[i]::DOUBLE", f"{b}[i]::DOUBLE"
    total = lambda body: f"list_sum({each.format(body)})"
    if distance == "cosine":
        return f"{total(f'{x} * {y}')} / sqrt({total(f'{x} * {x}')} * {total(f'{y} * {y}')})"
    if distance == "euclidean":
        return f"sqrt({total(f'({x} - {y}) * ({x} - {y})')})"
    return total(f"abs({x} - {y})")


def pair_scores(distance: str) -> str:
    return f"SELECT a.vec_id, round({_measure('a.embedding', 'b.embedding', distance)}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def nearest(distance: str) -> str:
    down = "DESC" if distance == "cosine" else "ASC"
    return (
        "WITH scored AS (SELECT q.vec_id AS query_id, p.vec_id AS id, "
        f"{_measure('q.embedding', 'p.embedding', distance)} AS score FROM embeddings q JOIN embeddings p ON q.vec_id % 50 = 0) "
        "SELECT query_id, rank::INTEGER AS rank, id, round(score, 6) AS score FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {down}, id) AS rank FROM scored) WHERE rank <= 5"
    )


def _cells(cells: int, probes: int, k: int) -> str:
    """exact and found: ranks of all pairs, and of those whose point lies in one of the cells that its question visits."""
    return f"""WITH centres AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, embedding FROM embeddings ORDER BY vec_id LIMIT {cells}),
away AS (SELECT v.vec_id, c.cell, {_measure('v.embedding', 'c.embedding', 'euclidean')} AS d FROM embeddings v, centres c),
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cell) AS place FROM away),
scored AS (SELECT q.vec_id AS query_id, p.vec_id AS id, {_measure('q.embedding', 'p.embedding', 'cosine')} AS score
  FROM embeddings q JOIN embeddings p ON q.vec_id % 50 = 0),
exact AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= {k}),
found AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.id) AS rank FROM scored s
  JOIN near p ON p.vec_id = s.id AND p.place = 1
  JOIN near q ON q.vec_id = s.query_id AND q.cell = p.cell AND q.place <= {probes} QUALIFY rank <= {k})
"""


def by_cells(cells: int, probes: int, k: int = 5) -> str:
    return f"{_cells(cells, probes, k)}SELECT query_id, rank::INTEGER AS rank, id, round(score, 6) AS score FROM found"


def recall_by_cells(cells: int, probes: int, k: int = 5) -> str:
    return f"{_cells(cells, probes, k)}SELECT e.query_id, round(avg(CASE WHEN f.id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall FROM exact e LEFT JOIN found f USING (query_id, id) GROUP BY e.query_id"
