"""Name functions: Column in, Column out. Everything but Jaro-Winkler stays in the JVM.

fold -> tokens -> core_tokens -> normalized / skeleton; the set and edit measures compare two of them.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Legal forms: they say little about who a party is. Kept in alphabetical order.
LEGAL_FORMS = tuple(
    "ab ad ag akz ao aps as asa associates association berhad bhd bv cjsc co company coop cooperative corp corporation cv dd"
    " doo eirl enterprise enterprises est establishment fgup foundation fsue fund gaisha gbr gk gmbh godo group gup holding"
    " holdings inc incorporated industries industry international intl jsc kabushiki kaisha kft kg kgaa kk lc lda limited llc"
    " lllp llp lp ltd mbh mup npo nv oao ohg ojs ojsc ooo oy oyj pao partnership persero pjsc plc pt pte pty sa sarl sas sdn"
    " se snc society sp spa spol srl srlcv sro sue tbk trust unipessoal yk yugen zao zoo zrt".split()
)
STOP_WORDS = tuple(sorted("a al an and da de del della di e el et for la las le les los of the und y".split()))
#: Words that stand for another; an empty one is dropped.
SAME_WORD = dict(
    pair.split("=")
    for pair in (
        "and= brothers=bros company=co corporation=corp development=dev engineering=engrg export=exp import=imp incorporated=inc"
        " industrial=indl international=intl limited=ltd manufacturing=mfg mount=mt research=res saint=st scientific=sci"
        " technologies=tech technology=tech trading=trade"
    ).split()
)
#: Romanisation digraphs, in the order of their replacement.
DIGRAPHS = tuple(tuple(p.split(">")) for p in "sch>s sh>s ch>c kh>k gh>g ph>f th>t zh>j dh>d ts>c ck>k qu>k ough>o x>ks".split())
_SPELLED_OUT = dict(zip("ßæÆœŒþÞ", "ss ae AE oe OE th TH".split()))
_ONE_FOR_ONE = dict(zip("øØđĐłŁðÐı", "oOdDlLdDi"))


@cache
def _decomposed() -> tuple[str, str, dict[str, str]]:
    """Characters with a one-character base, their bases, and those with a longer one."""
    source, target, longer = "", "", dict(_SPELLED_OUT)
    for cp in (*range(0xA0, 0x2500), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        c = chr(cp)
        base = _ONE_FOR_ONE.get(c) or "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c in longer or base == c or unicodedata.combining(c):
            continue
        if len(base) == 1:
            source, target = source + c, target + base
        elif len(base) in (2, 3) and base.isascii() and base.isalpha():
            longer[c] = base
    # marks without a letter of their own go: they have no counterpart
    marks = "".join(chr(cp) for cp in range(0x300, 0x370) if unicodedata.combining(chr(cp)))
    return source + marks, target, longer


def fold(text: Column) -> Column:
    """Lower case without accents or punctuation, single blanks."""
    source, target, longer = _decomposed()
    out = text
    for c, base in longer.items():
        out = F.replace(out, F.lit(c), F.lit(base))
    # all that is replaced lies beyond ASCII
    out = F.lower(F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(out, source, target)).otherwise(text))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


@pandas_udf(T.StringType())
def fold_any(text: pd.Series) -> pd.Series:
    """The full compatibility decomposition, for the few rows whose characters ``fold`` has no table for."""
    import re

    def one(s):
        if s is None:
            return None
        s = "".join(_SPELLED_OUT.get(c, _ONE_FOR_ONE.get(c, c)) for c in s)
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()
        return " ".join(re.sub(r"[^\w\s]", " ", s).split())

    return text.map(one)


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(folded: Column) -> Column:
    """Words of a folded name under one spelling, without stop words."""
    same = F.create_map(*[F.lit(x) for pair in SAME_WORD.items() for x in pair])
    alike = F.transform(F.split(folded, " "), lambda t: F.coalesce(F.element_at(same, t), t))
    return F.filter(alike, lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def core_tokens(words: Column) -> Column:
    """``tokens`` without legal forms, unless nothing else is left."""
    core = F.filter(words, lambda t: ~t.isin(*LEGAL_FORMS))
    return F.when(F.size(core) > 0, core).otherwise(words)


def skeleton(core: Column) -> Column:
    """Consonants of each core token: Slavic endings, digraphs and doubled letters brought together."""
    s = F.regexp_replace(F.array_join(core, " "), "(off?|o[vw]|eff|e[vw])(?= |$)", "ov")
    for a, b in DIGRAPHS:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(s, r"(\S)\1+", "$1"), r"(?<=\S)[aeiouy]", "")


def forms(name: Column) -> dict[str, Column]:
    """All comparison forms of a name by their column names."""
    core = core_tokens(tokens(fold(name)))
    skel = skeleton(core)
    return {
        "toks": core,
        "norm": F.array_join(core, " "),
        "sorted_norm": F.array_join(F.array_sort(core), " "),
        "skel": skel,
        "sorted_skel": F.array_join(F.array_sort(F.split(skel, " ")), " "),
    }


def with_forms(df, name: str, prefix: str = ""):
    """Adds the forms step by step, so that none is worked out twice."""
    p = prefix
    df = df.withColumn(p + "folded", fold(F.col(name))).withColumn(p + "words", tokens(F.col(p + "folded"))).withColumn(p + "toks", core_tokens(F.col(p + "words")))
    df = df.withColumn(p + "norm", F.array_join(p + "toks", " ")).withColumn(p + "sorted_norm", F.array_join(F.array_sort(p + "toks"), " "))
    df = df.withColumn(p + "skel", skeleton(F.col(p + "toks")))
    return df.withColumn(p + "sorted_skel", F.array_join(F.array_sort(F.split(p + "skel", " ")), " ")).drop(p + "folded", p + "words")


def _both(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens as a share of all; 0 if either side has none."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(_both(a, b) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Shared tokens as a share of the shorter side's."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(_both(a, b) / least)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer side."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longest))


def acronym_of(short: Column, toks: Column) -> Column:
    """Whether a name without blanks is the initials of at least two tokens."""
    plain = F.replace(short, F.lit(" "), F.lit(""))
    return (F.length(plain) >= 2) & (F.size(toks) >= 2) & (plain == F.array_join(F.transform(toks, lambda t: F.substring(t, 1, 1)), ""))


def jaro(one: str, other: str):
    """Jaro similarity; half transpositions count as halves."""
    if one == other or not (one and other):
        return float(one == other)
    reach = max(0, max(map(len, (one, other))) // 2 - 1)
    unused = set(range(len(other)))
    met = []
    for i, c in enumerate(one):
        near = next((j for j in range(max(0, i - reach), min(len(other), i + reach + 1)) if j in unused and other[j] == c), None)
        if near is not None:
            unused.discard(near)
            met.append(c)
    if not met:
        return 0.0
    back = [c for j, c in enumerate(other) if j not in unused]
    m, half = len(met), sum(map(str.__ne__, met, back)) / 2
    return sum((m / len(one), m / len(other), 1 - half / m)) / 3


def jaro_winkler_value(one: str, other: str):
    score = jaro(one, other)
    if score <= 0.7:
        return score
    same = next((k for k in range(4) if one[k : k + 1] != other[k : k + 1] or not one[k : k + 1]), 4)
    return score + 0.1 * same * (1 - score)


@pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_value(x, y) for x, y in zip(a, b)], dtype="float64")


#: Marked so that a filter on its result doesn't run it twice.
jaro_winkler = _jaro_winkler.asNondeterministic()


def variants(toks: Column, norm: Column, skel: Column) -> Column:
    """Distinct renderings: as is, reversed, sorted, skeleton."""
    return F.array_distinct(F.array(norm, F.array_join(F.reverse(toks), " "), F.array_join(F.array_sort(toks), " "), skel))
