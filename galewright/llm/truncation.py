"""Texts cut off by field limits or in transfer (problem 9).

Word trigrams of all texts are counted by what follows them: another word, the end of a sentence, or a bare end of a
line or text. Each text's final trigram is joined with these counts, and they decide: a bare ending is cut if its gram goes on
or ends a sentence elsewhere but hardly ever ends a line. A trigram that no other place of the corpus has backs off
to its last two words, to its last word, and for the rest of a word that was cut to the place after the two words before it. Where nothing is known,
nothing speaks for a cut. A sentence mark is an end that is counted like any other; one after a number was set by a cut if
the same place elsewhere holds decimals. Everything is SQL; grams travel as 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Blanks and invisible characters, and marks of omission at a text's end (regular expression).
BLANKS = r" \t\n\r\u000b\u000c\u0085 ​‎‏  　﻿"
OMISSION = r"(?:\\u2026|\\.\\.\\.+|[\\[(<](?:\\u2026|\\.\\.\\.+|cut|snip|more|truncated|continued|cont\\.?)[\\])>])"

#: What ends a sentence, with quotes and brackets that may follow. It is looked for only where a run of marks begins.
MARK = r"(?<![.!?。！？])[.!?。！？]++[\"”’»\\)\\]*_]*+"

#: A whole ending read backwards from the end of the last line: bracketed remarks, tags, emoticons and the like, and before them the
#: end of a sentence. Anchored and without ways back, so that it costs linear time.
WHOLE = r"^(?:(?>\\)[^()]*+\\(|\\][^\\[\\]]*+\\[|>[a-zA-Z0-9]++/<|[^\\pL\\pN\\s])[ \\t]*+)*?[\"”’»\\)\\]*_]*[.!?。！？]"

# Words end in one control character if a sentence ends there; digits count as 0; a line end is the word of a pilcrow, the
# text's end that of a black box. Marks are set once per text, so that no word meets a regular expression.
_SPLIT = r"""concat(array('¶', '¶', '¶', '¶', '¶'),
      array_remove(split(regexp_replace(regexp_replace(translate(lower(replace(<text>, '\r\n', '\n')), '123456789\t \r  ', '000000000  \n\n\n'), '<mark>(?=[\\s]|$)', '\u0001'), '\n+', ' ¶ '), ' '), ''),
      array('∎'))"""
# The last twelve pieces between single blanks hold the last five words and what stands before them, whatever their lengths.
_END = "substring_index(CASE WHEN contains(core, '  ') THEN regexp_replace(core, ' +', ' ') ELSE core END, ' ', -12)"

SQL = r"""
WITH cores AS (
  SELECT key, source, mark <> '' AS omitted, rtrim('<blank>', CASE WHEN length(mark) = 64 THEN rtrim('.', tail) ELSE substring(tail, 1, length(tail) - length(mark)) END) AS core
  FROM (SELECT *, regexp_extract(right(tail, 64), '(?i)(<omission>)$', 1) AS mark FROM (SELECT key, source, rtrim('<blank>', body) AS tail FROM {texts}) WHERE tail <> '')),
words AS (SELECT xxhash64(core) AS body, <words of texts> AS w FROM cores),
-- An ending that is neither a mark nor a letter or digit is judged by its line, of any length.
ends AS (
  SELECT key, source, xxhash64(core) AS body, omitted, x.* FROM cores LATERAL VIEW inline(array(named_struct(  -- worked out once per text
    'open_code', ((length(core) - length(replace(core, '```', ''))) div 3) % 2 = 1, 'w', <words of ends>,
    'whole', CASE WHEN right(core, 1) IN ('.', '!', '?', '。', '！', '？') OR endswith(core, '```') THEN true
      WHEN rlike(right(core, 1), '[\\pL\\pN]') THEN false
      WHEN endswith(core, '|') AND length(ltrim(' \t', <last line>)) > 1 AND startswith(ltrim(' \t', <last line>), '|') THEN true
      ELSE rlike(reverse(<last line>), '<whole>') END))) x),
grams AS (
  SELECT body, a, b, rtrim('\u0001', c) AS c, endswith(c, '\u0001') AS marked, d = '¶' OR d = '∎' AS last, startswith(c, '0') AS number, z, p = '¶' OR z = '¶' AS starts
  FROM words LATERAL VIEW inline(arrays_zip(w, slice(w, 2, size(w)), slice(w, 3, size(w)), slice(w, 4, size(w)), slice(w, 5, size(w)), slice(w, 6, size(w)))) x AS p, z, a, b, c, d
  WHERE d IS NOT NULL AND c <> '¶'),
-- One row per gram and, for bare ends, per text: copies of a text are one, and the levels below are sums of these rows.
occurrences AS (
  SELECT gram, pair, word, place, decimal, body, count_if(inside) AS inside, count_if(ended) AS ended, count_if(bare) AS bare
  FROM (SELECT gram, pair, word, place, decimal, inside, ended, bare, CASE WHEN bare THEN body END AS body
    FROM (SELECT *, NOT marked AND NOT last AS inside, marked AS ended, NOT marked AND last AS bare FROM grams)
    LATERAL VIEW inline(array(
      named_struct('gram', xxhash64(a, b, c), 'pair', xxhash64(b, c), 'word', xxhash64(c), 'place', xxhash64(a, b), 'decimal', CASE WHEN number THEN rlike(c, '^0+[.,]0') END),
      named_struct('gram', CASE WHEN starts THEN xxhash64(z, a, b, c) END, 'pair', NULL, 'word', NULL, 'place', NULL, 'decimal', NULL))) x AS gram, pair, word, place, decimal
    WHERE gram IS NOT NULL)
  GROUP BY gram, pair, word, place, decimal, body),
-- Counted are trigrams and the first four-grams of lines, and by the levels of the back-off pairs, words and places after two
-- words; of places before numbers decimals count as inside and whole numbers as ended.
counts AS (
  SELECT gram, sum(inside) AS inside, sum(ended) AS ended, sum(bare) AS bare, count(body) AS texts
  FROM (SELECT gram, body, sum(inside) AS inside, sum(ended) AS ended, sum(bare) AS bare
    FROM (SELECT x.gram, x.inside, x.ended, x.bare, body FROM occurrences o LATERAL VIEW inline(array(
      named_struct('gram', o.gram, 'inside', o.inside, 'ended', o.ended, 'bare', o.bare),
      named_struct('gram', CASE WHEN pair IS NOT NULL THEN xxhash64(pair, 2) END, 'inside', o.inside, 'ended', o.ended, 'bare', o.bare),
      named_struct('gram', CASE WHEN word IS NOT NULL THEN xxhash64(word, 1) END, 'inside', o.inside, 'ended', o.ended, 'bare', o.bare),
      named_struct('gram', CASE WHEN place IS NOT NULL THEN xxhash64(place, 0) END, 'inside', o.inside, 'ended', o.ended, 'bare', o.bare),
      named_struct('gram', CASE WHEN decimal IS NOT NULL THEN xxhash64(place, 9) END, 'inside', CASE WHEN decimal THEN o.inside + o.ended + o.bare ELSE 0L END, 'ended', CASE WHEN decimal THEN 0L ELSE o.inside + o.ended + o.bare END, 'bare', 0L))) x AS gram, inside, ended, bare
      WHERE x.gram IS NOT NULL)
    GROUP BY gram, body)
  GROUP BY gram),
judged AS (
  SELECT key, source, body, omitted, open_code, whole, x.* FROM ends LATERAL VIEW inline(array(named_struct(
    'p', w[size(w) - 6], 'z', w[size(w) - 5], 'a', w[size(w) - 4], 'b', w[size(w) - 3], 'e', rtrim('\u0001', w[size(w) - 2]), 'number_stop', rlike(w[size(w) - 2], '^0+\u0001$')))) x),
-- A mark or an open block of code is an end of its own; the others ask the counts.
finals AS (
  SELECT key, source, body, omitted, open_code, whole, number_stop, kind, gram FROM judged
  LATERAL VIEW inline(CASE WHEN open_code OR (whole AND NOT number_stop) THEN array(named_struct('kind', -1, 'gram', xxhash64(key, body))) ELSE array(
    named_struct('kind', 3, 'gram', xxhash64(a, b, e)), named_struct('kind', 2, 'gram', xxhash64(xxhash64(b, e), 2)), named_struct('kind', 1, 'gram', xxhash64(xxhash64(e), 1)),
    named_struct('kind', 0, 'gram', xxhash64(xxhash64(a, b), 0)), named_struct('kind', 4, 'gram', CASE WHEN p = '¶' OR z = '¶' THEN xxhash64(z, a, b, e) END),
    named_struct('kind', 9, 'gram', CASE WHEN number_stop THEN xxhash64(xxhash64(a, b), 9) END)) END) x AS kind, gram
  WHERE gram IS NOT NULL),
evidence AS (
  SELECT key, source, body, omitted, open_code, whole, number_stop, <counts by level>,
    max(CASE WHEN kind = 9 THEN c.inside END) AS decimals, max(CASE WHEN kind = 9 THEN c.ended END) AS wholes
  FROM finals f LEFT JOIN counts c ON f.gram = c.gram
  GROUP BY key, source, body, omitted, open_code, whole, number_stop),
decided AS (
  SELECT *, <known by level>
  FROM (SELECT *, inside_0 + ended_0 + bare_0 AS n_place FROM evidence))
SELECT key, source, omitted, open_code, whole, level, inside_3 AS inside, ended_3 AS ended, bare_3 AS bare, texts_3 AS texts, decimals, wholes,
  CASE WHEN open_code THEN true
    WHEN number_stop AND decimals >= 5 AND decimals >= 5 * (wholes - 1) THEN true
    WHEN whole OR inside_3 IS NULL THEN false  -- nothing but a mark of omission has no gram
    WHEN omitted THEN NOT (ended_3 >= 2 AND ended_3 >= 0.25 * inside_3)
    WHEN texts_4 >= 3 AND bare_4 >= inside_4 + ended_4 AND bare_4 >= 0.02 * n_place THEN false
    <decision by level>
    ELSE level IS NOT NULL END AS is_cut
FROM decided"""

#: The levels of the back-off, from the finest. One is asked where the corpus knows its gram beside the text's own end. A
#: trigram settles it either way; of shorter grams only those that go on more often than they end a line speak, and speak for
#: a cut, because beginnings of words that many texts were cut in would vouch for each other.
_BACK_OFF = (2, 1, 0)


def _by_level() -> dict[str, str]:
    goes_on = {k: f"inside_{k} + ended_{k} > texts_{k}" for k in _BACK_OFF}  # copies of a text end once
    known = "inside_3 + ended_3 >= 1 OR texts_3 >= 3 AND bare_3 >= 0.02 * n_place"
    return {
        "<counts by level>": ", ".join(f"max(CASE WHEN kind = {k} THEN c.{n} END) AS {n}_{k}" for k in (4, 3, *_BACK_OFF) for n in ("inside", "ended", "bare", "texts")),
        "<known by level>": f"CASE WHEN {known} THEN 3 " + " ".join(f"WHEN {goes_on[k]} THEN {k}" for k in _BACK_OFF) + " END AS level",
        "<decision by level>": "WHEN level = 3 THEN NOT (texts_3 >= 3 AND bare_3 >= inside_3 + ended_3 AND bare_3 >= 0.02 * n_place)",
        "<last line>": r"substring_index(replace(core, '\r', '\n'), '\n', -1)",
    }


def judged_texts(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per text that isn't null or blank: ``key``, ``source``, what its ending looks like and ``is_cut``.

    A key that stands in several rows is judged once for each of its different texts. Null sources
    stay null. Texts of any length are counted whole.
    """
    sql = SQL.replace("<words of texts>", _SPLIT.replace("<text>", "core")).replace("<words of ends>", _SPLIT.replace("<text>", _END))
    for name, part in _by_level().items():
        sql = sql.replace(name, part)
    for name, pattern in (("<omission>", OMISSION), ("<blank>", BLANKS), ("<mark>", MARK), ("<whole>", WHOLE)):
        sql = sql.replace(name, pattern)
    texts = df.selectExpr(f"`{key}` AS key", f"`{source}` AS source", f"CAST(`{text}` AS string) AS body")
    return df.sparkSession.sql(sql, texts=texts)


def cut_texts(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The keys of texts whose end is missing; null and blank texts are none."""
    return judged_texts(df, key, text, source).where("is_cut").selectExpr(f"key AS `{key}`")


def cut_share(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often each source cuts: ``(source, n_texts, n_cut, share)``."""
    judged = judged_texts(df, key, text, source)
    counts = judged.groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("is_cut").alias("n_cut"))
    return counts.select(F.col("source").alias(source), "n_texts", "n_cut", F.round(F.col("n_cut") / F.col("n_texts"), 6).alias("share"))
