"""The whole screening path as one DuckDB query: forms, blocking with its cap, signals, Jaro-Winkler, bands, best candidate."""

from __future__ import annotations

from partylens.functions import names as N
from partylens.operators import screening as S

FOLD = r"trim(regexp_replace(regexp_replace(lower(strip_accents(replace(replace(replace({x}, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'))), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def words(values) -> str:
    return "[" + ", ".join(f"'{w}'" for w in values) + "]"


_SAME = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in N.SAME_WORD.items()) + " ELSE w END"
TOKENS = f"list_filter(list_transform(string_split({{f}}, ' '), lambda w: {_SAME}), lambda w: w <> '' AND NOT list_contains({words(N.STOP_WORDS)}, w))"
CORE = f"CASE WHEN len(list_filter({{t}}, lambda w: NOT list_contains({words(N.LEGAL_FORMS)}, w))) > 0 THEN list_filter({{t}}, lambda w: NOT list_contains({words(N.LEGAL_FORMS)}, w)) ELSE {{t}} END"


def skeleton(core: str) -> str:
    word = "regexp_replace(w, '(off?|o[vw]|eff|e[vw])$', 'ov')"
    for a, b in N.DIGRAPHS:
        word = f"replace({word}, '{a}', '{b}')"
    # RE2 knows no back references; a digit may be doubled like a letter
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        word = f"regexp_replace({word}, '{c}{{2,}}', '{c}', 'g')"
    out = f"list_transform({core}, lambda w: {word})"
    return f"array_to_string(list_transform({out}, lambda w: left(w, 1) || regexp_replace(substr(w, 2), '[aeiouy]', '', 'g')), ' ')"


def jaro_winkler(pairs: str) -> str:
    """CTE bodies that end in jw (a, b, value) for the rows (a, b) of ``pairs``; half transpositions count as halves.

    The loop over a's characters folds a string: what is unused of b, a mark, what was met.
    """
    low = "greatest(1, CAST(left(e, length(e) - 1) AS BIGINT) - reach)"
    at = f"strpos(substr(left(s, m), {low}, greatest(0, least(m, CAST(left(e, length(e) - 1) AS BIGINT) + reach) - {low} + 1)), right(e, 1))"
    step = f"CASE WHEN {at} > 0 THEN left(s, {low} + {at} - 2) || chr(1) || substr(s, {low} + {at}) || right(e, 1) ELSE s END"
    same = " ".join(f"WHEN left(a, {k}) = left(b, {k}) AND least(n, m) >= {k} THEN {k}" for k in (4, 3, 2, 1))
    return f"""jp AS (SELECT DISTINCT a, b, length(a) AS n, length(b) AS m, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS reach FROM ({pairs})),
jf AS (SELECT *, list_reduce(list_concat([b || chr(2)], list_transform(range(1, n + 1), lambda i: i || substr(a, i, 1))), lambda s, e: {step}) AS s FROM jp),
jm AS (SELECT *, substr(s, m + 2) AS met, array_to_string(list_transform(list_filter(range(1, m + 1), lambda j: substr(s, j, 1) = chr(1)), lambda j: substr(b, j, 1)), '') AS back FROM jf),
jh AS (SELECT *, CAST(length(met) AS DOUBLE) AS k, len(list_filter(range(1, length(met) + 1), lambda j: substr(met, j, 1) <> substr(back, j, 1))) / 2 AS half FROM jm),
jj AS (SELECT *, CASE WHEN a = b THEN 1.0 WHEN n = 0 OR m = 0 OR k = 0 THEN 0.0 ELSE (k / n + k / m + (1 - half / k)) / 3 END AS j FROM jh),
jw AS (SELECT a, b, CASE WHEN j <= 0.7 OR a = b THEN j ELSE j + 0.1 * (CASE {same} ELSE 0 END) * (1 - j) END AS value FROM jj)"""


def forms(source: str, name: str, keep: str) -> str:
    """CTE bodies {source}_f to {source}_s: folded, words, toks, norm, sorted_norm, skel, sorted_skel of names with a token."""
    s = source
    return f"""{s}_f AS (SELECT {keep}, {FOLD.format(x=name)} AS folded FROM {s}), {s}_t AS (SELECT *, {TOKENS.format(f="folded")} AS words FROM {s}_f), {s}_c AS (SELECT *, {CORE.format(t="words")} AS toks FROM {s}_t),
{s}_k AS (SELECT *, array_to_string(toks, ' ') AS norm, array_to_string(list_sort(toks), ' ') AS sorted_norm, {skeleton("toks")} AS skel FROM {s}_c WHERE len(toks) > 0),
{s}_s AS (SELECT *, array_to_string(list_sort(string_split(skel, ' ')), ' ') AS sorted_skel FROM {s}_k)"""


def screening(subjects: str, parties: str, cap: int = S.BLOCK_CAP) -> str:
    """CTE bodies that end in ``found`` (every best candidate of a subject and party, NONE included) and ``cut_keys``.

    ``subjects`` selects (subject_id, name, aliases), ``parties`` (uid, source, name, aliases).
    """
    w = S.WEIGHTS
    skels = "string_split({0}_skel, ' ')"
    shorter = "least(len(list_distinct({a})), len(list_distinct({b})))"
    contained = lambda a, b: f"len(list_intersect({a}, {b})) / {shorter.format(a=a, b=b)}"
    acronym = lambda n, toks: f"(length(replace({n}, ' ', '')) >= 2 AND len({toks}) >= 2 AND replace({n}, ' ', '') = array_to_string(list_transform({toks}, lambda x: left(x, 1)), ''))"
    key_list = "list_distinct(list_concat(list_transform(toks, lambda x: {'kind': 0, 'key': x}), list_transform(list_filter(string_split(skel, ' '), lambda x: x <> ''), lambda x: {'kind': 1, 'key': x})))"
    return f"""subs AS ({subjects}), pars AS ({parties}),
qn AS (SELECT subject_id, unnest(list_concat([name], aliases)) AS query_name, unnest(range(len(aliases) + 1)) AS pos FROM subs),
q AS (SELECT subject_id, query_name, subject_id || '#' || pos AS query_id FROM qn WHERE trim(query_name) <> ''),
ln AS (SELECT uid, source, unnest(list_concat([name], aliases)) AS listed_name, unnest(range(len(aliases) + 1)) AS pos FROM pars),
l AS (SELECT uid, source, trim(listed_name) AS listed_name, uid || '#' || pos AS entry_id FROM ln WHERE trim(listed_name) <> '' QUALIFY row_number() OVER (PARTITION BY uid, lower(trim(listed_name)) ORDER BY pos) = 1),
{forms("q", "query_name", "subject_id, query_name, query_id")}, {forms("l", "listed_name", "uid, source, listed_name, entry_id")},
lk AS (SELECT entry_id, unnest({key_list}) AS k FROM l_s), qk AS (SELECT query_id, unnest({key_list}) AS k FROM q_s),
df AS (SELECT k.kind AS kind, k.key AS key, count(*) AS df FROM lk GROUP BY ALL),
ranked AS (SELECT query_id, k.kind AS kind, k.key AS key, coalesce(df, 0) AS df, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(df, 0), k.key, k.kind) AS rank FROM qk LEFT JOIN df ON df.kind = k.kind AND df.key = k.key),
met AS (SELECT query_id, entry_id, min(rank) AS rank FROM ranked r JOIN lk ON lk.k.kind = r.kind AND lk.k.key = r.key GROUP BY ALL),
fresh AS (SELECT query_id, rank, count(*) AS n FROM met GROUP BY ALL),
seen AS (SELECT r.*, coalesce(sum(n) OVER (PARTITION BY r.query_id ORDER BY r.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked r LEFT JOIN fresh f ON f.query_id = r.query_id AND f.rank = r.rank),
cut_keys AS (SELECT query_id, key, df FROM seen WHERE before >= {cap} AND df > 0),
told AS (SELECT subject_id, array_to_string(list_sort(list_distinct(list(key || ' (df=' || df || ')'))), '; ') AS left_out FROM cut_keys JOIN q USING (query_id) GROUP BY subject_id),
pair AS (SELECT m.query_id, m.entry_id FROM met m JOIN seen s ON s.query_id = m.query_id AND s.rank = m.rank AND s.before < {cap}),
common AS (SELECT list(key) AS common FROM df WHERE kind = 0 AND df > greatest(2, floor((SELECT count(*) FROM l_s) * {S.COMMON_SHARE}))),
both_sides AS (SELECT a.subject_id, a.query_id, a.query_name, b.entry_id, b.uid, b.source, b.listed_name, a.toks AS q_toks, b.toks AS l_toks, a.norm AS q_norm, b.norm AS l_norm, a.sorted_norm AS q_sorted, b.sorted_norm AS l_sorted, a.skel AS q_skel, b.skel AS l_skel, a.sorted_skel AS qs, b.sorted_skel AS ls,
  len(list_filter(list_intersect(a.toks, b.toks), lambda x: NOT list_contains(coalesce(common, []), x))) > 0 AS discriminating FROM pair JOIN q_s a USING (query_id) JOIN l_s b USING (entry_id) CROSS JOIN common),
sig AS (SELECT *, len(list_intersect(q_toks, l_toks)) / len(list_distinct(list_concat(q_toks, l_toks))) AS jaccard, {contained("q_toks", "l_toks")} AS containment, q_skel = l_skel OR qs = ls AS skeleton_equal, {contained(skels.format("q"), skels.format("l"))} AS skeleton_containment,
  len(q_toks) >= 2 AND len(l_toks) >= 2 AS multi, {acronym("q_norm", "l_toks")} OR {acronym("l_norm", "q_toks")} AS acronym FROM both_sides),
sig2 AS (SELECT *, CASE WHEN skeleton_equal THEN 1.0 WHEN multi THEN skeleton_containment ELSE 0.0 END AS skeleton FROM sig),
live AS (SELECT * FROM sig2 WHERE acronym OR containment = 1 OR (skeleton_containment = 1 AND multi) OR {w["jaro_winkler"]} + {w["edit"]} + {w["jaccard"]} * jaccard + {w["containment"]} * containment + {w["skeleton"]} * greatest(skeleton, skeleton_containment) >= {S.WEAK}),
{jaro_winkler("SELECT q_norm AS a, l_norm AS b FROM live UNION ALL SELECT q_sorted, l_sorted FROM live")},
edits AS (SELECT live.*, greatest(greatest(0, 1 - levenshtein(q_norm, l_norm) / greatest(length(q_norm), length(l_norm))), greatest(0, 1 - levenshtein(q_sorted, l_sorted) / greatest(length(q_sorted), length(l_sorted)))) AS edit,
  greatest(x.value, y.value) AS jaro_winkler FROM live JOIN jw x ON x.a = q_norm AND x.b = l_norm JOIN jw y ON y.a = q_sorted AND y.b = l_sorted),
scored AS (SELECT *, round({" + ".join(f"{k} * {v}" for k, v in w.items())}, 4) AS score FROM edits),
laddered AS (SELECT *, CASE WHEN q_norm = l_norm OR q_sorted = l_sorted THEN 'EXACT' WHEN least(length(replace(q_norm, ' ', '')), length(replace(l_norm, ' ', ''))) < {S.SHORT} THEN 'NONE' WHEN acronym THEN 'STRONG' WHEN containment = 1 AND skeleton_equal THEN 'STRONG'
  WHEN skeleton_containment = 1 AND multi THEN 'STRONG' WHEN containment = 1 AND discriminating THEN 'STRONG' WHEN score >= {S.STRONG} THEN 'STRONG' WHEN score >= {S.WEAK} THEN 'WEAK' ELSE 'NONE' END AS band FROM scored),
rungs AS (SELECT *, CASE band WHEN 'EXACT' THEN 3 WHEN 'STRONG' THEN 2 WHEN 'WEAK' THEN 1 ELSE 0 END AS band_rank FROM laddered),
found AS (SELECT * FROM rungs LEFT JOIN told USING (subject_id) QUALIFY row_number() OVER (PARTITION BY subject_id, uid ORDER BY band_rank DESC, score DESC, query_id, entry_id) = 1)"""


#: The columns of ``screening.screen``.
COLUMNS = "subject_id, uid, source, listed_name, query_name AS matched_name, band, band_rank, score, jaro_winkler, jaccard, containment, edit, skeleton, skeleton_equal, acronym, discriminating, left_out"
