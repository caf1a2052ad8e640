"""License scans: sparse TF-IDF cosine of header lines and licence files to templates, then inheritance by directories.

All in DataFrame operations. Lines that carry a cue of a licence are reduced to their different token sequences, so a
notice that a third of all documents carry is weighed once; document frequencies are counted over all such lines. By the
same frequencies are scored: lines without a cue, and runs of lines, as notices are wrapped, against the notices; and
whole texts, as licence files are, against texts of licences. Texts that have too little of every template's weight
are left aside first, in one pass. Of runs and texts only those leave their row whose cosine
may reach the threshold by the terms that they share with a template, any other term weighing 1 at least. A document
without a notice of its own takes that of the nearest directory above it that holds a licence file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lograil.llm._common import WORD, materialize, word_count

#: Short notices by licence, lower case.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "this program is licensed under the gnu affero general public license version 3"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the license apache license version 2.0"),
    ("BSD-2-Clause", "redistribution and use in source and binary forms with or without modification are permitted bsd 2 clause license"),
    ("BSD-3-Clause", "licensed under the bsd 3 clause license neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    ("CC-BY-4.0", "licensed under cc by 4.0 creative commons attribution 4.0 international license"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4.0"),
    ("CC-BY-NC-4.0", "creative commons attribution noncommercial 4.0 international license"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4.0"),
    ("CC0-1.0", "released under cc0 1.0 universal public domain dedication"),
    ("GPL-2.0", "this work is licensed under the gnu general public license version 2"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted isc license"),
    ("LGPL-3.0", "this library is licensed under the gnu lesser general public license version 3"),
    ("MIT", "released under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software mit license"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("Unlicense", "this is free and unencumbered software released into the public domain unlicense"),
]
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_3 = " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = " this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0} public license as published by the free software foundation either version {1} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0} public license for more details you should have received a copy of the gnu {0} public license along with this program"
#: Texts that whole licence files consist of, lower case; of the long licences what they have files say.
TEXTS: list[tuple[str, str]] = [
    ("AGPL-3.0", _GNU.format("affero general", 3)),
    ("Apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("GPL-2.0", _GNU.format("general", 2)),
    ("GPL-3.0", _GNU.format("general", 3)),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("LGPL-3.0", _GNU.format("lesser general", 3)),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0"),
    ("Unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
]
#: By lines with one of these, document frequencies are counted.
CUE = "licen[sc]e|copyright|spdx|creative commons|public domain|permission (is hereby|to use)|redistribution and use"
#: Terms of templates that are looked for last, which changes no result.
EVERYDAY = frozenset("a all and any are as at be but by copy copies conditions for free from in including is it its may more not of on one or other out persons see so that the them this to under use used was we whether will with without work you your".split())
THRESHOLD = 0.7
FILE_SHARE = 0.25
#: Tokens of a run of lines (with equal weights more than 51 have less than THRESHOLD to the longest notice); lines looked at together.
SPAN, PART = 60, 1000


def tokens(text: Column) -> Column:
    """Runs of letters, digits and inner dots of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+(?:\\.[0-9]+)*"), F.lit(0))


def templates(spark: SparkSession, known: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """template, license, tokens: as many rows as known, whatever the input."""
    return spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(known)], "template int, license string, notice string").select("template", "license", tokens(F.col("notice")).alias("tokens"))


def texts(spark: SparkSession) -> DataFrame:
    """template, license, tokens of TEXTS, each different token once."""
    return templates(spark, TEXTS).select("template", "license", F.array_distinct("tokens").alias("tokens"))


def frequencies(lines: DataFrame) -> DataFrame:
    """term, df: lines with the term, of distinct token sequences (key, tokens, n), n times each; the null term has their number."""
    terms = lines.select("n", F.explode(F.array_distinct("tokens")).alias("term"))
    total = lines.agg(F.lit(None).cast("string").alias("term"), F.coalesce(F.sum("n"), F.lit(0)).alias("df"))
    return materialize(terms.groupBy("term").agg(F.sum("n").alias("df")).unionAll(total), "frequencies")


def weighed(known: DataFrame, counts: DataFrame) -> DataFrame:
    """template, license, term, idf, tw of templates. idf = ln((1 + lines) / (1 + lines with the term)) + 1; tw = count * idf."""
    each = known.select("template", "license", F.explode("tokens").alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    df = counts.where("term is not null").join(F.broadcast(each.select("term").distinct()), "term")
    idf = F.log((1 + F.col("total")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    total = counts.where("term is null").select(F.col("df").alias("total"))
    return each.join(df, "term", "left").join(F.broadcast(total)).select("template", "license", "term", idf.alias("idf"), (F.col("tf") * idf).alias("tw"))


def score_lines(lines: DataFrame, known: DataFrame, counts: DataFrame) -> DataFrame:
    """key, license, score of each distinct token sequence (key, tokens) that reaches THRESHOLD, by the best of known templates."""
    terms = lines.select("key", F.explode("tokens").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    total = counts.where("term is null").select(F.col("df").alias("total"))
    idf = F.log((1 + F.col("total")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    weights = terms.join(counts.where("term is not null"), "term", "left").join(F.broadcast(total)).select("key", "term", (F.col("tf") * idf).alias("w"))
    ours = weighed(known, counts)
    norms = weights.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    their = ours.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    dots = weights.join(F.broadcast(ours), "term").groupBy("key", "template", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, "key").join(F.broadcast(their), "template").select("key", "license", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6).alias("score"))
    best = F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("license")))
    return scored.where(F.col("score") >= THRESHOLD).groupBy("key").agg(best.alias("b")).select("key", "b.*")


def may_reach(toks: Column, known: Column, vocabulary: Column) -> Column:
    """Whether the cosine of tokens to one of the known templates (norm, terms: term, idf, tw; their vocabulary) may reach THRESHOLD.

    The terms in common have THRESHOLD squared of the template's squared norm, or no text reaches it; and the cosine is no
    more than if each of the others weighed 1.
    """
    add = lambda f: lambda acc, x: acc + f(x)
    zero, least = F.lit(0.0), THRESHOLD - 1e-6

    def reaches(t: Column, met: Column, different: Column) -> Column:
        common = F.filter(t["terms"], lambda x: F.array_contains(met, x["term"]))
        mass = F.aggregate(common, zero, add(lambda x: x["tw"] * x["tw"]))
        counted = F.transform(common, lambda x: F.struct((x["idf"] * F.size(F.filter(toks, lambda y: y == x["term"]))).alias("w"), x["tw"].alias("tw")))
        sums = F.aggregate(counted, F.struct(zero.alias("dot"), zero.alias("own")), lambda acc, x: F.struct((acc["dot"] + x["w"] * x["tw"]).alias("dot"), (acc["own"] + x["w"] * x["w"]).alias("own")))
        others = different - F.size(common)
        return F.when(mass < least * least * t["norm"] * t["norm"], F.lit(False)).otherwise(F.transform(F.array(sums), lambda s: s["dot"] >= least * t["norm"] * F.sqrt(s["own"] + others))[0])

    once = F.array(F.struct(F.array_intersect(toks, vocabulary).alias("met"), F.size(F.array_distinct(toks)).alias("n")))
    return F.exists(once, lambda o: F.exists(known, lambda t: reaches(t, o["met"], o["n"])))


def with_mass(keyed: DataFrame, ours: DataFrame) -> DataFrame:
    """The rows of keyed whose terms in common with one of the weighed templates have THRESHOLD squared of its squared norm: no
    part of another text reaches it, as a part has no terms that the whole has not. Terms are counted before they are weighed."""
    least = (THRESHOLD - 1e-6) ** 2
    squares = F.sort_array(F.transform("terms", lambda x: x["tw"] * x["tw"]), False)
    nil = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    add = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), (acc["n"] + F.when(acc["sum"] < least * F.col("norm") * F.col("norm"), 1).otherwise(0)).alias("n"))
    each = _normed(ours).select("norm", "terms", F.transform("terms", lambda x: x["term"]).alias("names"), F.aggregate(squares, nil, add)["n"].alias("need"))
    packed = each.agg(F.collect_list(F.struct("norm", "terms", "names", "need")).alias("known"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("vocabulary"))

    def heavy(t: Column, met: Column) -> Column:
        common = F.filter(t["terms"], lambda x: F.array_contains(met, x["term"]))
        mass = F.aggregate(common, F.lit(0.0), lambda acc, x: acc + x["tw"] * x["tw"])
        return (F.size(F.array_intersect(met, t["names"])) >= t["need"]) & (mass >= least * t["norm"] * t["norm"])

    once = F.array(F.array_intersect(tokens(F.col("text")), F.col("vocabulary")))
    return keyed.join(F.broadcast(packed)).where(F.exists(once, lambda met: F.exists("known", lambda t: heavy(t, met)))).drop("known", "vocabulary")


def cued_terms(ours: DataFrame) -> str:
    """A pattern of the terms of which each text with a cosine of THRESHOLD to a template has one: so many that those left have
    less than THRESHOLD squared of its squared norm, words of everyday English last."""
    of: dict[int, list[tuple[bool, float, str]]] = {}
    for r in ours.collect():  # as many as the terms of fixed values
        of.setdefault(r.template, []).append((r.term in EVERYDAY, -r.tw, r.term))
    out = set()
    for terms in of.values():
        rest = all_ = sum(w * w for _, w, _ in terms)
        for _, w, term in sorted(terms):
            if rest < (THRESHOLD - 1e-6) ** 2 * all_:
                break
            out.add(term.replace(".", "\\.") if "." in term else f"{term}(?![a-z0-9])")
            rest -= w * w
    # a term may follow on a number, and letters on a number with dots, as `tokens` has it
    return f"(?<![a-z])(?:{'|'.join(sorted(out))})"


def _normed(ours: DataFrame) -> DataFrame:
    """norm, terms: one row a template."""
    return ours.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("norm"), F.collect_list(F.struct("term", "idf", "tw")).alias("terms"))


def _packed(ours: DataFrame) -> DataFrame:
    """One row: known and vocabulary, as `may_reach` takes them."""
    return _normed(ours).agg(F.collect_list(F.struct("norm", "terms")).alias("known"), F.array_distinct(F.flatten(F.collect_list(F.transform("terms", lambda x: x["term"])))).alias("vocabulary"))


def wrapped(keyed: DataFrame, ours: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, path, th, words, own_words, license, score of texts with runs of lines, blank ones skipped, that reach THRESHOLD:
    the best run's, and the words of all runs that have no smaller such run in them, each line once. Lines with a cue are no
    runs alone, nor are their words counted here.

    A run has SPAN tokens at most: with terms of equal weight a longer one has less than THRESHOLD to any notice.
    """
    pattern = cued_terms(ours)
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.struct(tokens(x).alias("t"), x.alias("line"))), lambda x: F.size(x["t"]) > 0)
    lines = F.transform(lines, lambda x: F.struct(x["t"], x["line"], F.rlike(F.array_join(x["t"], " "), F.lit(pattern)).alias("hit")))
    asked = keyed.where(F.lower("text").rlike(pattern)).select("doc_id", "path", "th", lines.alias("ls"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("ls") - 1, F.lit(0)), F.lit(PART))
    parts = asked.where("size(ls) > 0").select("doc_id", "path", "th", F.explode(F.transform(starts, lambda k: F.struct(k.alias("at"), F.slice("ls", k + 1, PART + SPAN).alias("ls")))).alias("p")).select("doc_id", "path", "th", "p.*")
    sized = parts.select("*", F.transform("ls", lambda x: F.size(x["t"])).alias("sizes"))
    nil = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
    add = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), (acc["n"] + F.when(acc["sum"] + x <= SPAN, 1).otherwise(0)).alias("n"))
    fit = lambda i: F.aggregate(F.slice("sizes", i, SPAN), nil, add)["n"]
    fits = F.transform(F.sequence(F.lit(1), F.least(F.size("ls"), F.lit(PART))), lambda i: F.struct((F.col("at") + i).alias("first"), F.slice("ls", i, fit(i)).alias("ls")))
    begun = sized.select("doc_id", "path", "th", F.explode(F.filter(fits, lambda x: F.exists(x["ls"], lambda line: line["hit"]))).alias("s")).select("doc_id", "path", "th", "s.*")
    runs = begun.select("doc_id", "path", "th", "first", F.explode(F.transform(F.sequence(F.lit(1), F.size("ls")), lambda n: F.slice("ls", 1, n))).alias("ls"))
    toked = runs.select("*", F.flatten(F.transform("ls", lambda x: x["t"])).alias("tokens")).join(F.broadcast(_packed(ours)))
    likely = toked.where(may_reach(F.col("tokens"), F.col("known"), F.col("vocabulary"))).select(
        "doc_id", "path", "th", "first", (F.col("first") + F.size("ls") - 1).alias("last"), ((F.size("ls") == 1) & F.lower(F.col("ls")[0]["line"]).rlike(CUE)).alias("line"), F.transform("ls", lambda x: word_count(x["line"])).alias("ws"), "tokens", F.sha2(F.array_join("tokens", " "), 256).alias("key")
    )
    likely = materialize(likely.distinct(), "runs")
    scores = score_lines(likely.groupBy("key").agg(F.first("tokens").alias("tokens")), templates(keyed.sparkSession), counts)
    each = Window.partitionBy("doc_id", "path", "th")
    inner = F.min("last").over(each.orderBy(F.desc("first"), "last").rowsBetween(Window.unboundedPreceding, -1))
    every = likely.drop("tokens").join(scores, "key")
    seen = F.greatest(F.lag("last").over(each.orderBy("first")) - F.col("first") + 1, F.lit(0))
    least = every.withColumn("inner", inner).where("inner is null or inner > last").withColumn("seen", F.coalesce(seen, F.lit(0)))
    count = F.aggregate(F.slice("ws", F.col("seen") + 1, F.size("ws")), F.lit(0).cast("long"), lambda acc, x: acc + x)
    counted = least.where("not line").select("doc_id", "path", "th", count.alias("own_words"), "license", "score")
    found = every.where("not line").select("doc_id", "path", "th", F.lit(0).cast("long").alias("own_words"), "license", "score").unionAll(counted)
    best = F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("license")))
    own = materialize(found.groupBy("doc_id", "path", "th").agg(best.alias("b"), F.sum("own_words").alias("own_words")).select(F.col("doc_id").alias("_i"), F.col("path").alias("_p"), F.col("th").alias("_h"), "own_words", "b.*"), "own-runs")
    sized = keyed.join(own.select("_h").distinct(), F.col("th") == F.col("_h"), "left_semi").select("doc_id", "path", "th", word_count(F.col("text")).alias("words")).distinct()
    return sized.join(own, F.col("doc_id").eqNullSafe(F.col("_i")) & F.col("path").eqNullSafe(F.col("_p")) & (F.col("th") == F.col("_h"))).select("doc_id", "path", "th", "words", "own_words", "license", "score")


def whole(keyed: DataFrame, ours: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, path, th, words, own_words, license, score of the whole texts that reach THRESHOLD to the text of a licence; here
    each different term counts once on both sides."""
    once = F.array_distinct(F.col("tokens")).alias("tokens")
    asked = keyed.where(F.lower("text").rlike(cued_terms(ours))).select("doc_id", "path", "th", "text", tokens(F.col("text")).alias("tokens"))
    likely = asked.select("doc_id", "path", "th", "text", once).join(F.broadcast(_packed(ours))).where(may_reach(F.col("tokens"), F.col("known"), F.col("vocabulary")))
    likely = likely.select("doc_id", "path", "th", word_count(F.col("text")).alias("words"), "tokens", F.sha2(F.array_join(F.array_sort("tokens"), " "), 256).alias("key"))
    likely = materialize(likely.dropDuplicates(["doc_id", "path", "th"]), "whole")
    scores = score_lines(likely.groupBy("key").agg(F.first("tokens").alias("tokens")), texts(keyed.sparkSession), counts)
    return likely.join(scores, "key").select("doc_id", "path", "th", "words", F.col("words").alias("own_words"), "license", "score")


def parent(path: Column) -> Column:
    """The directory of a path; '' for the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """The directory and all above it, nearest first, each with its depth."""
    parts = F.split(directory, "/")
    up = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("dir"), n.alias("depth")))
    top = F.array(F.struct(F.lit("").alias("dir"), F.lit(0).alias("depth")))
    return F.when(directory == "", top).otherwise(F.concat(up, top))


def scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """One row for each row of files: doc_id, path, license, score, origin ('own', 'inherited', 'none') and from_dir.

    own: the best line or run of lines of the whole text that reaches THRESHOLD, or the whole text as a licence file, ties
    to the first licence by name. A file of which FILE_SHARE of the words are in such lines, or that reaches THRESHOLD as a
    whole, is a licence file of its directory (several: the best, then the first path).
    Null and empty texts have no notice; null paths are in no directory and inherit nothing; rows that repeat a path,
    id and text get the same result; other columns are not read; an empty table gives no rows.
    """
    keyed = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    cued = keyed.where(F.lower("text").rlike(CUE))
    found = cued.select("doc_id", "path", "th", word_count(F.col("text")).alias("words"), F.explode(F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(CUE))).alias("line"))
    found = found.dropDuplicates(["doc_id", "path", "th", "line"]).select("doc_id", "path", "th", "words", word_count(F.col("line")).alias("own_words"), tokens(F.col("line")).alias("tokens"))
    notices = materialize(found.withColumn("key", F.sha2(F.array_join("tokens", " "), 256)), "notices")
    lines = notices.groupBy("key").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n"))
    lines = materialize(lines, "lines")
    counts = frequencies(lines)
    scores = score_lines(lines, templates(files.sparkSession), counts)
    best = F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("license")))
    alone = notices.join(scores, "key").select("doc_id", "path", "th", "words", "own_words", "license", "score")
    short, long = (materialize(weighed(known, counts), name) for known, name in ((templates(files.sparkSession), "notices-weighed"), (texts(files.sparkSession), "texts-weighed")))
    heavy = materialize(with_mass(keyed, short.unionAll(long.withColumn("template", F.col("template") + len(TEMPLATES)))), "with-mass")
    every = alone.unionByName(wrapped(heavy, short, counts)).unionByName(whole(heavy, long, counts))
    owned = materialize(every.groupBy("doc_id", "path", "th", "words").agg(best.alias("b"), F.sum("own_words").alias("own_words")).select("doc_id", "path", "th", "words", "own_words", "b.*"), "owned")
    is_file = (F.col("own_words") >= FILE_SHARE * F.col("words")) & F.col("path").isNotNull()
    dirs = owned.where(is_file).groupBy(parent(F.col("path")).alias("dir")).agg(F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("path"), F.col("license"))).alias("d")).select("dir", "d.*")
    asked = keyed.where("path is not null").select(parent(F.col("path")).alias("asked")).distinct()
    reach = asked.select("asked", F.explode(ancestors(F.col("asked"))).alias("a")).select("asked", "a.*")
    near = materialize(reach.join(dirs, "dir").groupBy("asked").agg(F.max_by(F.struct("dir", "license", "score"), "depth").alias("near")), "near")
    own = owned.select(F.col("doc_id").alias("_i"), F.col("path").alias("_p"), F.col("th").alias("_h"), F.col("license").alias("own"), F.col("score").alias("own_score"))
    slim = keyed.select("doc_id", "path", "th")
    joined = slim.join(own, F.col("doc_id").eqNullSafe(F.col("_i")) & F.col("path").eqNullSafe(F.col("_p")) & (F.col("th") == F.col("_h")), "left").join(near, parent(F.col("path")) == F.col("asked"), "left")
    has = F.col("own").isNotNull()
    return joined.select(
        "doc_id", "path", F.coalesce("own", "near.license").alias("license"), F.when(has, F.col("own_score")).otherwise(F.col("near.score")).alias("score"),
        F.when(has, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(~has, F.col("near.dir")).alias("from_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """documents as files: the source is the project, ids by thousands and by hundreds the folders in it."""
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    return docs.select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), part(1000), part(100), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))


def oracle() -> str:
    """The scan of documents in DuckDB's SQL."""
    values = ", ".join(f"({i}, '{k}', '{t}')" for i, (k, t) in enumerate(TEMPLATES))
    toks = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+(?:\\.[0-9]+)*')"
    words = lambda x: f"len(regexp_extract_all({x}, '{WORD}'))"
    return f"""
with tmpl(template, license, notice) as (values {values}),
f as (select doc_id, text, concat_ws('/', coalesce(source, 'unknown'), doc_id // 1000, doc_id // 100, doc_id || '.txt') as path from documents),
p as (select *, regexp_replace(path, '/?[^/]*$', '') as dir from f),
l as (select doc_id, path, dir, {words('text')} as words, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), '{CUE}'))) as line from p),
n as (select *, {toks('line')} as toks, array_to_string({toks('line')}, ' ') as k from (select distinct * from l)),
lines as (select k, any_value(toks) as toks, count(*) as n from n group by k),
tot as (select coalesce(sum(n), 0) as total from lines),
terms as (select k, n, term, count(*) as tf from (select k, n, unnest(toks) as term from lines) group by all),
df as (select term, sum(n) as df from terms group by term),
w as (select k, terms.term, tf * (ln((1 + total) / (1 + df)) + 1) as w from terms join df on terms.term = df.term, tot),
tt as (select template, license, term, count(*) as tf from (select template, license, unnest({toks('notice')}) as term from tmpl) group by all),
tw as (select template, license, tt.term, tf * (ln((1 + total) / (1 + coalesce(df, 0))) + 1) as tw from tt left join df on tt.term = df.term, tot),
nk as (select k, sqrt(sum(w * w)) as norm from w group by k),
nt as (select template, sqrt(sum(tw * tw)) as tnorm from tw group by template),
s as (select k, license, round(dot / (norm * tnorm), 6) as score from (select k, template, license, sum(w * tw) as dot from w join tw using (term) group by all) d join nk using (k) join nt using (template)),
b as (select k, license, score from s where score >= {THRESHOLD} qualify row_number() over (partition by k order by score desc, license) = 1),
o as (select *, sum(ow) over (partition by doc_id) as own_words from (select doc_id, path, dir, words, {words('line')} as ow, license, score from n join b using (k)) qualify row_number() over (partition by doc_id order by score desc, license) = 1),
d as (select dir, license, score from o where own_words >= {FILE_SHARE} * words qualify row_number() over (partition by dir order by score desc, path, license) = 1),
near as (select p.doc_id, d.* from p join d on p.dir = d.dir or starts_with(p.dir, d.dir || '/') or d.dir = '' qualify row_number() over (partition by p.doc_id order by length(d.dir) desc) = 1)
select p.doc_id, p.path, coalesce(o.license, near.license) as license, case when o.license is not null then o.score else near.score end as score,
case when o.license is not null then 'own' when near.license is not null then 'inherited' else 'none' end as origin, case when o.license is null then near.dir end as from_dir
from p left join o on p.doc_id = o.doc_id left join near on p.doc_id = near.doc_id
"""
