"""SQL texts that are made from parts."""

from __future__ import annotations


def folded(items: str, start: str, step: str, out: str, chunk: int = 256) -> str:
    """Spark SQL: ``aggregate`` over the array ``items`` with state ``struct(at, out)``, ``out`` growing by a few elements of type ``out`` a step.

    An array that grows in one ``aggregate`` is copied whole at every step. Here only that of a chunk is; ``step`` is ``(a, x) -> ...``.
    """
    return (
        f"aggregate(sequence(0, (size({items}) - 1) div {chunk}), struct({start} as at, cast(array() as array<array<{out}>>) as outs), (o, c) -> "
        f"transform(array(aggregate(slice({items}, c * {chunk} + 1, {chunk}), struct(o.at as at, cast(array() as array<{out}>) as out), {step})), "
        "y -> struct(y.at as at, concat(o.outs, array(y.out)) as outs))[0], o -> struct(o.at as at, flatten(o.outs) as out))"
    )


def centroid_rounds(clusters: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """The plain algorithm: every round computes all distances anew, one CTE after the other."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) = {dim} AND list_count(embedding) = {dim} AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))))""",
        f"p AS MATERIALIZED (SELECT rid, unnest(range(1, {dim + 1})) AS i, unnest(x) AS x FROM v)",
        f"first AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), x) - 1 AS k, x FROM v QUALIFY k < {clusters})",
        f"c0 AS MATERIALIZED (SELECT k, unnest(range(1, {dim + 1})) AS i, unnest(x) AS y FROM first)",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS MATERIALIZED (SELECT rid, k, sum((x - y) * (x - y)) AS d FROM p JOIN c{r} USING (i) GROUP BY rid, k)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, arg_min(k, d * {clusters} + k) AS k, min(d) AS d FROM d{r} GROUP BY rid)")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce(m.y, c.y) AS y FROM c{r} c LEFT JOIN
    (SELECT k, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS y FROM (SELECT k, i, sum(x) AS s, count(*) AS n FROM p JOIN a{r} USING (rid) GROUP BY k, i)) m ON m.k = c.k AND m.i = c.i)""")
    return f"""WITH {", ".join(parts)},
s AS (SELECT k, sum(d) AS s FROM a{rounds} GROUP BY k), h AS (SELECT k, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k)
SELECT v.vec_id, a.k::INTEGER AS cluster, a.d::BIGINT AS distance, s.s::BIGINT AS cluster_inertia, (SELECT sum(s) FROM s)::BIGINT AS inertia, h.h AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN s ON s.k = a.k JOIN h ON h.k = a.k"""


#: The trie by its definition: prefixes as texts of hashes, crc32 bit by bit, totals over all members of a node.
CONVERSATION_TRIE = """
WITH c0 AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, md5(len(role) || ':' || role || text) AS h, len(text) AS size FROM c0),
ids AS (SELECT DISTINCT c, c - c % 100 AS base, list_reduce([4294967295::UBIGINT] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [(1000 + ascii(s))::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: CASE WHEN x >= 1000 THEN xor(a, x - 1000) ELSE xor(a >> 1, 3988292384::UBIGINT * (a & 1)) END) AS crc FROM own),
convs AS MATERIALIZED (SELECT c, base, xor(crc, 4294967295::UBIGINT) % 6 AS h FROM ids),
turns AS (SELECT v.c, o.pos, o.h AS hash, o.size FROM convs v JOIN own o ON o.c = v.base AND o.pos < v.h
    UNION ALL SELECT o.c, o.pos, o.h, o.size FROM convs v JOIN own o ON o.c = v.c AND o.pos >= v.h),
placed AS MATERIALIZED (SELECT c, d, size, string_agg(hash, '') OVER (PARTITION BY c ORDER BY d) AS node FROM (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, hash, size FROM turns)
    UNION ALL SELECT c, 0, 0, '' FROM convs),
ends AS (SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS e FROM (SELECT c, arg_max(node, d) AS node FROM placed GROUP BY c) GROUP BY node),
nodes AS MATERIALIZED (SELECT node, d, min(c) AS c, count(*) AS n, max(size) AS size FROM placed GROUP BY node, d),
kids AS (SELECT left(node, 32 * (d - 1)) AS node, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY 1),
each AS (SELECT p.c, p.d, p.node, CASE WHEN n.c = p.c THEN (n.n - 1) * n.size ELSE 0 END AS saved, CASE WHEN n.c = p.c AND k.kids IS NULL THEN 1 ELSE 0 END AS leaf
    FROM placed p JOIN nodes n USING (node) LEFT JOIN kids k USING (node)),
below AS (SELECT node, sum(s) AS saved, sum(l) AS leaves FROM (SELECT node, sum(saved) OVER w AS s, sum(leaf) OVER w AS l FROM each WINDOW w AS (PARTITION BY c ORDER BY d DESC)) GROUP BY node)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, p.c AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(k.kids, 0)::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens,
    coalesce(e.e, sha256('')) AS ends_sha256
FROM nodes n JOIN below b USING (node) LEFT JOIN kids k USING (node) LEFT JOIN ends e USING (node) LEFT JOIN nodes p ON n.d > 0 AND p.node = left(n.node, 32 * (n.d - 1))"""
