"""The two operators that SQL can express, written from their definitions for DuckDB."""

from __future__ import annotations

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _leaf(text: str) -> str:
    """The digest of a row of ``documents``."""
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE CAST(strlen({v}) AS VARCHAR) || ':' || {v} END" for v in values) + ")"


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit: a byte goes in, eight shifts follow."""
    shifts = ", ".join(["CAST(-1 AS BIGINT)"] * 8)
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda k: [CAST(ascii(substr({text}, k, 1)) AS BIGINT), {shifts}]))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), CAST(4294967295 AS BIGINT))"


def _levels(name: str, leaves: str) -> str:
    """Levels of trees, up from their leaves ``tree, i, n, digest``."""
    return f"""{name} AS (SELECT tree, 0 AS level, i, n, digest FROM {leaves} UNION ALL
 SELECT tree, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, level, i // 16, n)"""


def _steps(name: str, levels: str, leaves: str, at: int) -> str:
    """Siblings to the left and right of each leaf's way, per level."""
    return f"""{name} AS (SELECT l.tree, l.i, {at} + s.level AS level, coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (s.i < l.i // (16 ** s.level)::BIGINT), '') AS a, coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (s.i > l.i // (16 ** s.level)::BIGINT), '') AS b
 FROM {leaves} l JOIN {levels} s ON s.tree = l.tree AND s.n > 1 AND s.i // 16 = l.i // (16 ** (s.level + 1))::BIGINT GROUP BY l.tree, l.i, s.level)"""


MERKLE = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS tree, {_leaf('text')} AS digest, CASE WHEN {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 5 = 0 THEN {_leaf(f"translate(text, '{_AZ}', '{_AZ.lower()}')")} END AS suspect FROM documents),
 leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
 {_levels('low', 'leaves')},
 subroots AS MATERIALIZED (SELECT 't' AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
 {_levels('high', 'subroots')},
 {_steps('below', 'low', 'leaves', 0)},
 {_steps('above', 'high', 'subroots', 100)},
 way AS (SELECT tree, i, level, a, b FROM below UNION ALL SELECT l.tree, l.i, u.level, u.a, u.b FROM leaves l JOIN subroots s ON s.name = l.tree JOIN above u ON u.i = s.i),
 whole AS (SELECT tree, i, list({{'a': a, 'b': b}} ORDER BY level) AS steps FROM way GROUP BY tree, i),
 folded AS (SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, (SELECT digest FROM high WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(w.steps, lambda x: x.a || x.b), ''), '')) AS proof_sha256,
  list_reduce(list_prepend({{'a': coalesce(l.suspect, l.digest), 'b': ''}}, coalesce(w.steps, [])), lambda acc, x: {{'a': sha256(x.a || acc.a || x.b), 'b': ''}}).a AS folded_root
  FROM leaves l JOIN subroots s ON s.name = l.tree LEFT JOIN whole w ON w.tree = l.tree AND w.i = l.i)
 SELECT *, folded_root = root AS verified FROM folded"""


def codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds with every distance computed; whole numbers below 2 ** 53 are exact."""
    ctes = [
        "k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v, row_number() OVER (ORDER BY vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE)))) AS r FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT r, part, x, list_inner_product(x, x) AS xx FROM (SELECT r, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM k CROSS JOIN range({parts}) g(part)) q)",
        f"c0 AS MATERIALIZED (SELECT part, r - 1 AS e, x, xx FROM p WHERE r <= {entries})",
    ]
    for t in range(rounds + 1):
        ctes.append(f"a{t} AS MATERIALIZED (SELECT p.r, p.part, min({{'d': p.xx - 2 * list_inner_product(p.x, c.x) + c.xx, 'e': c.e}}) AS z FROM p JOIN c{t} c ON c.part = p.part GROUP BY p.r, p.part)")
        if t < rounds:
            each = f"SELECT p.part, a.z.e AS e, unnest(p.x) AS y, unnest(range(len(p.x))) AS k FROM p JOIN a{t} a ON a.r = p.r AND a.part = p.part"
            ctes.append(f"m{t} AS (SELECT part, e, list(m ORDER BY k) AS x FROM (SELECT part, e, k, floor(sum(y) / count(*)) AS m FROM ({each}) u GROUP BY part, e, k) w GROUP BY part, e)")
            ctes.append(f"c{t + 1} AS MATERIALIZED (SELECT part, e, x, list_inner_product(x, x) AS xx FROM (SELECT c.part, c.e, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN m{t} m ON m.part = c.part AND m.e = c.e) q)")
    last = f"SELECT r, string_agg(printf('%02x', z.e), '' ORDER BY part) AS code, CAST(sum(z.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r"
    book = f"SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY part, e)) FROM c{rounds}"
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, ({book}) AS codebooks_sha256 FROM k JOIN ({last}) l USING (r)"
