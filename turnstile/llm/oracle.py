"""DuckDB SQL for the queries of this package that SQL can express on whole tables."""

from __future__ import annotations

QUALITY = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: length(translate(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '')) > 0) AS lines
  FROM documents
), numbered AS (SELECT row_number() OVER () AS r, * FROM t),
windows AS (
  SELECT r, i, words[i : i + 2] AS w
  FROM numbered, unnest(range(1, greatest(len(words) - 1, 1))) AS u(i)
), often AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM often, unnest([0, 1, 2]) AS u(k) GROUP BY r
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         length(text) - length(translate(text, '!', '')) AS n_exclaims,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper
  FROM numbered LEFT JOIN covered USING (r)
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_exclaims > n_words THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END
    + CASE WHEN word_chars > 15 * n_words THEN 128 ELSE 0 END)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""

EXACT = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM t
"""

def _allot(parts: str, out: str, group: str, party: str) -> str:
    """``own`` of the ``words`` of each group: ``quota`` blocks by their quotients, then the rest party by party."""
    same = " AND ".join(f"p.{c} IS NOT DISTINCT FROM q.{c}" for c in (*group.split(", "), party))
    return f"""{out}_won AS (
  SELECT {group}, {party}, count(*) AS won FROM (
    SELECT p.*, row_number() OVER (PARTITION BY {group} ORDER BY size / (2 * k - 1) DESC, {party}, k) AS place
    FROM {parts} p, unnest(range(1, coalesce(quota, 0) + 1)) AS u(k) WHERE size > 0
  ) WHERE place <= quota GROUP BY ALL
), {out}_cut AS (
  SELECT p.*, least(coalesce(won, 0) * 128, 2 * size) AS cut FROM {parts} p LEFT JOIN {out}_won q ON {same}
), {out}_rest AS (SELECT *, words - sum(cut) OVER (PARTITION BY {group}) AS rest FROM {out}_cut),
{out}_room AS (SELECT *, CASE WHEN rest > 0 THEN 2 * size - cut ELSE cut END AS room FROM {out}_rest),
{out}_own AS (
  SELECT * EXCLUDE (words, rest, room, cut), (cut + sign(rest) * least(room, greatest(0, abs(rest) - coalesce(sum(room) OVER (
      PARTITION BY {group} ORDER BY {party} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS own
  FROM {out}_room
),"""


#: Every block's quotient is made and ranked here; the operator ranks only those near the cut.
_MIX = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS digest
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), level AS (
  SELECT max(l) AS l FROM (
    SELECT (1.5 * (SELECT sum(source_size) FROM s)
            - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l,
           2 * source_size / weight AS top
    FROM s WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
  ) WHERE l < top
), t AS (
  SELECT s.*, CASE WHEN l IS NULL OR 2 * source_size <= weight * l THEN (2 * source_size)::DOUBLE ELSE weight * l END AS target
  FROM s, level
), total AS (SELECT round(sum(target) / 128)::BIGINT AS blocks FROM t),
source_quotients AS (
  SELECT source, target / (2 * k - 1) AS q, k FROM t, total, unnest(range(1, blocks + 1)) AS u(k) WHERE target > 0
), source_quota AS (
  SELECT source, count(*) AS quota
  FROM (SELECT source, row_number() OVER (ORDER BY q DESC, source NULLS LAST, k) AS place FROM source_quotients), total
  WHERE place <= blocks GROUP BY source
), dealt AS (
  SELECT d.*, ('0x' || substr(digest, 1, 8))::BIGINT % ceil(n_docs / 1000)::BIGINT AS shard, source_size, target
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), bundle_of AS (SELECT source, shard, shard // 1000 AS bundle, sum(size)::BIGINT AS size FROM dealt GROUP BY ALL),
source_parts AS (
  SELECT b.source, bundle, sum(b.size)::BIGINT AS size, quota, round(target)::BIGINT AS words
  FROM bundle_of b JOIN t ON b.source IS NOT DISTINCT FROM t.source
       LEFT JOIN source_quota z ON b.source IS NOT DISTINCT FROM z.source GROUP BY ALL
), {allot_bundles}
bundle_parts AS (
  SELECT b.source, b.bundle, shard, b.size, round(own / 128)::BIGINT AS quota, own AS words
  FROM bundle_of b JOIN bundles_own o ON b.source IS NOT DISTINCT FROM o.source AND b.bundle = o.bundle
), {allot_shards}
w AS (SELECT source, shard, size AS shard_size, own AS words FROM shards_own
), placed AS (
  SELECT dealt.*, shard_size, words,
         CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS rounds,
         sum(size) OVER (PARTITION BY dealt.source, dealt.shard ORDER BY digest, doc_id, size, r
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ends
  FROM dealt JOIN w ON dealt.source IS NOT DISTINCT FROM w.source AND dealt.shard = w.shard
)
SELECT doc_id, size, source_size, target,
       (rounds * size + least(size, greatest(0, words - rounds * shard_size - (ends - size))))::BIGINT AS taken
FROM placed
"""

MIX = _MIX.replace("{allot_bundles}", _allot("source_parts", "bundles", "source", "bundle")).replace(
    "{allot_shards}", _allot("bundle_parts", "shards", "source, bundle", "shard")
)

#: As many levels as trees of 16^6 documents and 16^4 sources have; levels above a root hand it on.
_DOC_LEVELS, _SOURCE_LEVELS = 6, 4


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text, bit by bit: each character and seven more steps."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))"
    return f"xor(list_reduce({bits}, {step}, 4294967295::BIGINT), 4294967295)"


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    joined = " || ".join(f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in fields)
    return f"sha256({joined})"


def _levels(name: str, levels: int) -> str:
    """From ``{name}0`` (s, i, n, d: tree, index, nodes, digest) and ``{name}f0`` (r, s, i, now, proof) upwards."""
    run = "PARTITION BY s, i // 16 ORDER BY i ROWS BETWEEN"
    out = []
    for k in range(levels):
        out.append(f"""
{name}x{k} AS (
  SELECT s, i, n, d,
         CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
         CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS g
  FROM {name}{k}
), {name}{k + 1} AS (
  SELECT s, i // 16 AS i, (n + 15) // 16 AS n,
         CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d
  FROM {name}{k} GROUP BY s, i // 16, n
), {name}f{k + 1} AS (
  SELECT r, s, i // 16 AS i, CASE WHEN n > 1 THEN sha256(l || now || g) ELSE now END AS now, proof || l || g AS proof
  FROM {name}f{k} JOIN {name}x{k} USING (s, i)
),""")
    return "".join(out)


MANIFEST = f"""
WITH names AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM (SELECT DISTINCT source FROM documents)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, s, {_leaf("text")} AS leaf,
         CASE WHEN {_crc32("coalesce(doc_id::VARCHAR, '')")} % 5 = 0
              THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
              ELSE {_leaf("text")} END AS tried
  FROM (SELECT d.*, s FROM documents d JOIN names ON d.source IS NOT DISTINCT FROM names.source)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n
  FROM docs
), a0 AS (SELECT s, i, n, leaf AS d FROM placed), af0 AS (SELECT r, s, i, tried AS now, '' AS proof FROM placed),
{_levels("a", _DOC_LEVELS)}
t0 AS (SELECT 0 AS s, s AS i, count(*) OVER () AS n, d FROM a{_DOC_LEVELS}),
tf0 AS (SELECT r, 0 AS s, s AS i, now, proof FROM af{_DOC_LEVELS}),
{_levels("t", _SOURCE_LEVELS)}
found AS (SELECT d AS root FROM t{_SOURCE_LEVELS})
SELECT p.doc_id, leaf, a.d AS subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified
FROM placed p JOIN a{_DOC_LEVELS} a ON a.s = p.s JOIN tf{_SOURCE_LEVELS} f ON f.r = p.r, found
"""

NEGATIVES = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
), parts AS (
  SELECT r, vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM rows
), scores AS (
  SELECT a.r AS a, b.r AS b, any_value(a.vec_id) AS anchor_id, any_value(b.vec_id) AS vec_id,
         any_value(a.label = b.label) AS alike, sum(a.x * b.x)::BIGINT AS score
  FROM parts a JOIN parts b ON a.k = b.k AND a.r <> b.r WHERE a.vec_id % 100 = 0 GROUP BY a.r, b.r
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) AS p FROM scores WHERE alike)
  WHERE p <= 5
), negatives AS (
  SELECT p.a, p.p, p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score,
         n.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.p ORDER BY n.score DESC, n.vec_id, n.b) AS rank
  FROM positives p JOIN scores n ON n.a = p.a AND NOT n.alike
  WHERE 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""

ORACLES: dict[str, str] = {
    "op4_quality_rules": QUALITY,
    "op9_source_mix": MIX,
    "op11_merkle_manifest": MANIFEST,
    "op13_hard_negatives": NEGATIVES,
    "op10_exact_dedup": EXACT,
}
