"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from sievelake.llm.queries import LANGUAGE_WEIGHTS, MIX_EPOCHS, MIX_SHARE, SHARDS


def _crc_steps() -> str:
    """What four bits add to a CRC-32, by the rule of its polynomial."""
    out = []
    for bits in range(16):
        for _ in range(4):
            bits = (bits >> 1) ^ (0xEDB88320 if bits & 1 else 0)
        out.append(str(bits))
    return f"[{', '.join(out)}]"


OP9 = f"""
WITH swapped AS (
  SELECT doc_id, source, text, coalesce(octet_length(encode(text)), 0) + 8 AS size,
         regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\\2\\1', 'g') AS nibbles
  FROM documents
), summed AS (
  SELECT doc_id, source, size, xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(regexp_extract_all(nibbles, '.'), lambda d: ('0x' || d)::BIGINT)),
           lambda c, x: 0::BIGINT + xor(c >> 4, {_crc_steps()}[(xor(c, x) & 15) + 1])), 4294967295) AS text_crc32
  FROM swapped
), ranked AS (
  SELECT *, md5('shards:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
         row_number() OVER (PARTITION BY source ORDER BY md5('shards:' || coalesce(doc_id::VARCHAR, 'null')), doc_id) AS r,
         count(*) OVER (PARTITION BY source) AS n
  FROM summed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (r - 1 + 0.5::DOUBLE) / n,
           CASE WHEN source IS NULL THEN '-' ELSE length(source) || '=' || source END, h, doc_id) - 1 AS place,
         count(*) OVER () AS total
  FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * {SHARDS} // total)::INTEGER AS shard,
       place - ((place * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""

_LANGUAGE = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in LANGUAGE_WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"


def _fill(name: str, above: str, path: list[str], weight: str) -> str:
    """Shares of one level: the children of each node in order of capacity by weight, up to the level that is not full."""
    keys, up = ", ".join(path), ", ".join(path[:-1]) or "0"
    on = " AND ".join(f"n.{c} = p.{c}" for c in path[:-1]) or "true"
    parent = up if path[:-1] else "0"
    return f"""
{name}_n AS (SELECT {keys}, sum(cap) AS cap FROM leaves GROUP BY {keys}),
{name}_w AS (SELECT n.*, p.budget AS above, {weight.replace("lang", "n.lang")} AS w FROM {name}_n n JOIN {above} p ON {on}),
{name}_o AS (SELECT *, row_number() OVER o AS pos,
    greatest(above - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::DOUBLE
      / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM {name}_w WINDOW o AS (PARTITION BY {parent} ORDER BY cap::DOUBLE / w, {path[-1]})),
{name}_s AS (SELECT *, min(CASE WHEN cap::DOUBLE / w > level THEN pos END) OVER (PARTITION BY {parent}) AS stop FROM {name}_o),
{name} AS (SELECT {keys}, CASE WHEN stop IS NULL OR pos < stop THEN cap::DOUBLE
    ELSE max(CASE WHEN pos = stop THEN level END) OVER (PARTITION BY {parent}) * w END AS budget FROM {name}_s)"""


OP10 = f"""
WITH docs AS (
  SELECT doc_id, lang AS lang_0, source AS source_0, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> ''
              THEN 'domain' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::INTEGER % 4) ELSE 'other' END AS domain,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents
), leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS available, sum(n_tokens)::BIGINT * {MIX_EPOCHS} AS cap FROM docs GROUP BY ALL),
top AS (SELECT least(floor(sum(available) * {MIX_SHARE}::DOUBLE), sum(cap))::DOUBLE AS budget FROM leaves),
{_fill("b1", "top", ["domain"], "1.0::DOUBLE")},
{_fill("b2", "b1", ["domain", "lang"], _LANGUAGE)},
{_fill("b3", "b2", ["domain", "lang", "source"], "1.0::DOUBLE")},
budgets AS (
  SELECT domain, lang, source, available, floor(round(budget, 6))::BIGINT AS budget,
         CASE WHEN available > 0 THEN floor(round(budget, 6))::BIGINT // available ELSE 1 END AS whole
  FROM b3 JOIN leaves USING (domain, lang, source)
), marked AS (
  SELECT d.*, whole, CASE WHEN available > 0 THEN budget - available * whole ELSE 0 END AS rest
  FROM docs d JOIN budgets USING (domain, lang, source)
), every AS (
  SELECT m.*, unnest(range(whole)) AS epoch FROM marked m
), part AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('mix:' || whole || ':' || coalesce(doc_id::VARCHAR, 'null')), doc_id, n_tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM marked WHERE rest > 0
)
SELECT doc_id, lang_0 AS lang, source_0 AS source, n_tokens, epoch::INTEGER AS epoch, n_tokens AS take FROM every WHERE epoch = 0 OR n_tokens > 0
UNION ALL
SELECT doc_id, lang_0, source_0, n_tokens, whole::INTEGER, least(n_tokens, rest - start) FROM part WHERE start < rest AND (n_tokens > 0 OR whole = 0)
"""

OP4 = """
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS near FROM sets
  UNION SELECT r.doc_id, CASE WHEN l.a = r.near THEN l.b ELSE l.a END FROM reach r JOIN links l ON r.near IN (l.a, l.b)
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, low AS component_id, doc_id = low AS kept
FROM sets JOIN (SELECT doc_id, min(near) AS low FROM reach GROUP BY doc_id) USING (doc_id)
"""

OP5 = """
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)
), later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM later, (SELECT unnest(range(20)) AS j)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words),
kept AS (
  SELECT doc_id, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE g.pos IS NULL) AS rest
  FROM each LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + ")"
_RISE = "list_transform(range(0, (len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], '')))"


def _sibling(place: str, level: str) -> str:
    """The side and digest of a place's sibling among the nodes of a level, `-` where there is none."""
    own = f"({place} >> {level})"
    return f"CASE WHEN {own} % 2 = 1 THEN 'L' || nodes[{own}] ELSE coalesce('R' || nodes[{own} + 2], '-') END"


OP11 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, {_LEAF.format(n_chars="n_chars")} AS leaf, {_LEAF.format(n_chars="(n_chars + 1)")} AS changed, n_chars,
         regexp_replace(hex(encode(doc_id::VARCHAR)), '(.)(.)', '\\2\\1', 'g') AS nibbles
  FROM documents
), leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, leaf, CASE WHEN n_chars IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(regexp_extract_all(nibbles, '.'), lambda d: ('0x' || d)::BIGINT)),
           lambda c, x: 0::BIGINT + xor(c >> 4, {_crc_steps()}[(xor(c, x) & 15) + 1])), 4294967295) % 7 = 0 THEN changed ELSE leaf END AS given,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM docs
), levels AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY place) AS nodes FROM leaves GROUP BY tree
  UNION ALL SELECT tree, level + 1, {_RISE} FROM levels WHERE len(nodes) > 1
), subroots AS (
  SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM levels WHERE len(nodes) = 1
), upper_levels AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL SELECT level + 1, {_RISE} FROM upper_levels WHERE len(nodes) > 1
), siblings AS (
  SELECT doc_id, leaf, given, tree, place, list({_sibling("place", "level")} ORDER BY level) FILTER (WHERE len(nodes) > 1) AS own
  FROM leaves JOIN levels USING (tree) GROUP BY ALL
), upper_siblings AS (
  SELECT tree, subroot, list({_sibling("place", "level")} ORDER BY level) FILTER (WHERE len(nodes) > 1) AS more
  FROM subroots, upper_levels GROUP BY ALL
), climbed AS (
  SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM upper_levels WHERE len(nodes) = 1) AS root, given, coalesce(own, []) || coalesce(more, []) AS way
  FROM siblings JOIN upper_siblings USING (tree)
), folded AS (
  SELECT *, list_reduce(list_prepend(given, way), lambda h, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || h) WHEN 'R' THEN sha256(h || s[2:]) ELSE sha256(h) END) AS folded_root
  FROM climbed
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(way, lambda s: s <> '-'), lambda s: s[2:]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""

_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP12 = f"""
WITH words AS (SELECT doc_id, row_number() OVER () AS row, {_TERMS} AS t FROM documents),
corpus AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM words WHERE len(t) > 0),
counts AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM words) GROUP BY ALL),
asked AS (SELECT row, item_id, term, count(*) AS c FROM (SELECT item_id, row_number() OVER () AS row, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, corpus GROUP BY term, n_docs
), scored AS (
  SELECT a.row, item_id, c.row AS doc_row, doc_id, sum(a.c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked a JOIN weights USING (term) JOIN counts c USING (term), corpus GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

ORACLE = {"op12_ranked_search": OP12, "op11_manifest": OP11, "op5_without_repeats": OP5, "op4_near_duplicates": OP4, "op9_interleave": OP9, "op10_mix": OP10}
