"""DuckDB SQL for the manifest query: the trees level by level, a few common table expressions each."""

from __future__ import annotations

# Levels written out; 3 ** 14 rows of one group, and as many groups.
LEVELS = 14


def _field(expression: str, text: bool) -> str:
    size = f"octet_length(encode({expression}))" if text else f"length(CAST({expression} AS VARCHAR))"
    return f"coalesce({size} || ':' || {expression}, '-')"


def _tree(p: str) -> list[str]:
    """From {p}0 (k, idx, m, digest): levels {p}1 ... and the siblings of their nodes, {p}r0 ..."""
    out = []
    for h in range(LEVELS):
        run = "PARTITION BY k, idx // 3 ORDER BY idx ROWS BETWEEN"
        out.append(f"""{p}r{h} AS MATERIALIZED (SELECT k, idx, m,
            coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
            coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
            FROM {p}{h})""")
        out.append(f"""{p}{h + 1} AS MATERIALIZED (SELECT k, idx // 3 AS idx, (m + 2) // 3 AS m,
            CASE WHEN m > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE min(digest) END AS digest
            FROM {p}{h} GROUP BY k, idx // 3, m)""")
    return out


def _paths(f: str, p: str) -> list[str]:
    """From {f}0 (row, k, idx, folded, proof): the fold and the proof after each level."""
    return [f"""{f}{h + 1} AS MATERIALIZED (SELECT row, k, f.idx // 3 AS idx,
            CASE WHEN m > 1 THEN sha256(lefts || folded || rights) ELSE folded END AS folded,
            proof || lefts || rights AS proof
            FROM {f}{h} f JOIN {p}r{h} r USING (k) WHERE f.idx = r.idx)""" for h in range(LEVELS)]


def manifest_sql() -> str:
    others = " || ".join(_field(c, c in ("source", "lang")) for c in ("doc_id", "source", "lang", "n_chars"))
    # Bit by bit: each byte of the decimal id is mixed in, then seven steps without one.
    crc = """xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
            lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
            lambda s, b: xor(xor(s, b) >> 1, CASE WHEN xor(s, b) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295), 4294967295)"""
    parts = [
        f"""leaves AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS k,
            sha256({others} || {_field('text', True)}) AS leaf,
            CASE WHEN {crc} % 2 = 0
                THEN sha256({others} || {_field("replace(text, chr(10), '')", True)}) END AS altered
            FROM documents)""",
        """rows AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY k, doc_id NULLS FIRST, leaf) AS row,
            row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf, coalesce(altered, '')) - 1 AS idx,
            count(*) OVER (PARTITION BY k) AS m FROM leaves)""",
        "g0 AS MATERIALIZED (SELECT k, idx, m, leaf AS digest FROM rows)",
        *_tree("g"),
        f"tops AS MATERIALIZED (SELECT k AS name, digest, row_number() OVER (ORDER BY k) - 1 AS idx FROM g{LEVELS})",
        "t0 AS MATERIALIZED (SELECT 0 AS k, idx, count(*) OVER () AS m, digest FROM tops)",
        *_tree("t"),
        "f0 AS MATERIALIZED (SELECT row, k, idx, coalesce(altered, leaf) AS folded, '' AS proof FROM rows)",
        *_paths("f", "g"),
        f"""u0 AS MATERIALIZED (SELECT row, 0 AS k, t.idx, folded, proof
            FROM f{LEVELS} f JOIN tops t ON f.k = t.name)""",
        *_paths("u", "t"),
    ]
    return f"""WITH {', '.join(parts)}
        SELECT doc_id, leaf, tops.digest AS subroot, t.digest AS root, sha256(u.proof) AS proof_sha256,
            u.folded AS folded_root, u.folded = t.digest AS verified
        FROM rows JOIN tops ON rows.k = tops.name JOIN u{LEVELS} u USING (row) CROSS JOIN t{LEVELS} t"""
