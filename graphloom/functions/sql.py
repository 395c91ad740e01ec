"""Functions of this library by name, for SQL.

Scalar functions are SQL functions: their bodies are inlined into a query and stay inside the JVM. Chunking follows an order
within each text, so it is a table function whose rows come and go in Arrow batches, for use with LATERAL.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import text

#: Characters of a chunk unless a caller names another number.
CHARS = 360
_TOKENS = f"filter(regexp_extract_all(lower(t), r'{text._STOP_OR_TOKEN}', 1), x -> x <> '')"
#: name: (parameters, type, body)
SCALARS = {
    "gl_tokens": ("t STRING", "ARRAY<STRING>", _TOKENS),
    "gl_token_set": ("t STRING", "ARRAY<STRING>", f"array_distinct({_TOKENS})"),
    "gl_overlap": ("a STRING, b STRING", "ARRAY<STRING>", f"sort_array(array_intersect({_TOKENS.replace('lower(t)', 'lower(a)')}, {_TOKENS.replace('lower(t)', 'lower(b)')}))"),
    "gl_estimate_tokens": ("t STRING", "BIGINT", r"cast(ceil(size(filter(split(t, r'\s+'), w -> w <> '')) * 1.35D) AS BIGINT)"),
    "gl_canonical_uri": ("u STRING", "STRING", "regexp_replace(regexp_replace(u, r'(?s)#.*$', ''), r'/+$', '')"),
    "gl_stable_id": ("prefix STRING, parts ARRAY<STRING>", "STRING", "concat(prefix, ':', substring(sha1(array_join(parts, '::')), 1, 12))"),
    "gl_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
}
CHUNKS = "key string, ordinal int, start int, end int, text string"


def _chunk_table():
    from ..operators.chunks import cut_points

    @F.udtf(returnType=CHUNKS, useArrow=True)
    class ChunkText:
        """(key, ordinal, start, end, text) of each chunk of a text; key is what the caller gives."""

        def eval(self, key: str, body: str, most: int = CHARS):
            flat = " ".join((body or "").split())
            kept = ((a, b, piece) for a, b in cut_points(flat, most or CHARS) if (piece := flat[a:b].strip()))
            for i, (a, b, piece) in enumerate(kept):
                yield key, i, a, b, piece

    return ChunkText


def register(spark: SparkSession) -> None:
    """Make the functions known to a session: those of SCALARS, and gl_chunks(key, text, characters)."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("gl_chunks", _chunk_table())
