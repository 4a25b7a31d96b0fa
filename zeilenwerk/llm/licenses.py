"""License scans by diagonal voting.

A text's words are hashed in rolling k-grams (PHRASE_K words for the short phrases, NOTICE_K for the notices) and
joined with the k-grams of all templates. A hit at word p of a text and word q of a template votes for the diagonal
p - q; hits are checked word by word, so that no hash stands in for words. A phrase is there where its diagonal has
all its votes. For notices, neighbouring diagonals that differ by no more than GAP are merged (words may be left out or
put in), within a band as wide as the template has words; bands overlap by half, so that none of them parts a span that
drifts by less. A span counts if at least COVER of the template's k-grams voted, each place in the template once however
often a text repeats it.

The templates are a fixed list, so they are broadcast; nothing is shuffled but one row a document and the votes.

Null and empty texts have no words and no label. Null ids and repeated rows keep their own rows. Texts may be long:
a text's hits are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PHRASE_K, NOTICE_K = 2, 4
GAP, COVER = 4, 0.6
#: Phrases (label, words): all their places count.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Notices (label, words), as their publishers word them.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
)
#: Texts and headers (label, words), as their publishers word them, without names and years; bsl without its disclaimer,
#: of the unlicense the first paragraph.
TEXTS = (
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to
        whom the software is furnished to do so subject to the following conditions the above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the software the software is provided as
        is without warranty of any kind express or implied including but not limited to the warranties of merchantability
        fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for
        any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
        connection with the software or the use or other dealings in the software"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met 1 redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice
        this list of conditions and the following disclaimer in the documentation and or other materials provided with the
        distribution this software is provided by the copyright holders and contributors as is and any express or implied
        warranties including but not limited to the implied warranties of merchantability and fitness for a particular
        purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect
        incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or
        services loss of use data or profits or business interruption however caused and on any theory of liability whether
        in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this
        software even if advised of the possibility of such damage"""),
    ("bsd-3-clause", """neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies the software is
        provided as is and the author disclaims all warranties with regard to this software including all implied warranties
        of merchantability and fitness in no event shall the author be liable for any special direct indirect or
        consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of
        contract negligence or other tortious action arising out of or in connection with the use or performance of this
        software"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held
        liable for any damages arising from the use of this software permission is granted to anyone to use this software for
        any purpose including commercial applications and to alter it and redistribute it freely subject to the following
        restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original
        software if you use this software in a product an acknowledgment in the product documentation would be appreciated
        but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being
        the original software 3 this notice may not be removed or altered from any source distribution"""),
    ("bsl", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license the software to use reproduce display distribute execute and
        transmit the software and to prepare derivative works of the software and to permit third parties to whom the
        software is furnished to do so all subject to the following the copyright notices in the software and this entire
        statement including the above license grant this restriction and the following disclaimer must be included in all
        copies of the software in whole or in part and all derivative works of the software unless such copies or derivative
        works are solely in the form of machine executable object code generated by a source language processor"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify
        publish use compile sell or distribute this software either in source code form or as a compiled binary for any
        purpose commercial or non commercial and by any means"""),
    ("apache", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with
        the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by
        applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language
        governing permissions and limitations under the license"""),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general
        public license as published by the free software foundation either version 3 of the license or at your option any
        later version this program is distributed in the hope that it will be useful but without any warranty without even
        the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for
        more details you should have received a copy of the gnu general public license along with this program if not see
        https www gnu org licenses"""),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    text = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def templates(spark) -> DataFrame:
    """gram, template, kind, label, tpos, n_grams, tokens: a row for each k-gram of each template."""
    rows = []
    for n, (label, text) in enumerate([*PHRASES, *NOTICES, *TEXTS]):
        w, k = text.split(), PHRASE_K if n < len(PHRASES) else NOTICE_K
        rows += [(n, n < len(PHRASES), label, i, len(w) - k + 1, w[i : i + k]) for i in range(len(w) - k + 1)]
    df = spark.createDataFrame(rows, "template int, phrase boolean, label string, tpos int, n_grams int, tokens array<string>")
    t = F.col("tokens")
    two = lambda i: F.xxhash64(F.try_element_at(t, F.lit(i)), F.try_element_at(t, F.lit(i + 1)))
    return df.withColumn("gram", F.when(F.col("phrase"), two(1)).otherwise(F.xxhash64(two(1), two(3))))


def spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row, keep, n_words and, for each span, template, phrase, label, start, stop (words), cover. A document without
    spans has one row whose template is null."""
    rows = docs.select(*keep, words(F.col(text)).alias("__w")).withColumn("row", F.monotonically_increasing_id())
    n = F.size("__w")
    # the last grams hash fewer words; they are no word of a template's
    pairs = F.zip_with("__w", F.slice(F.col("__w"), F.lit(2), F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumn("__two", pairs)
    four = F.zip_with("__two", F.slice(F.col("__two"), F.lit(3), F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    # one more gram, which is in no template, keeps a row for every document
    rows = rows.withColumn("__g", F.concat("__two", four, F.array(F.lit(0).cast("bigint"))))
    every = rows.select("row", *keep, n.alias("n_words"), "__w", F.posexplode("__g").alias("__p", "gram"))
    known = templates(docs.sparkSession)
    end = known.limit(1).select(F.lit(None).cast("int").alias("template"), F.lit(False).alias("phrase"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("tpos"), F.lit(1).alias("n_grams"), F.array().cast("array<string>").alias("tokens"), F.lit(0).cast("bigint").alias("gram"))
    hits = every.join(F.broadcast(known.unionByName(end)), "gram")
    last = F.col("template").isNull()
    pos = F.when(F.col("phrase"), F.col("__p")).otherwise(F.col("__p") - F.col("n_words"))
    hits = hits.where(F.when(last, F.col("__p") == 2 * F.col("n_words")).otherwise((pos >= 0) & (F.slice("__w", F.greatest(pos, F.lit(0)) + 1, F.size("tokens")) == F.col("tokens"))))
    hits = hits.select("row", *keep, "n_words", "template", "phrase", "label", "n_grams", "tpos", F.when(~last, pos).alias("pos"))
    key = ["row", *keep, "n_words", "template", "phrase", "label", "n_grams"]
    # a template's places bound the sets
    votes = hits.repartition(F.col("row")).groupBy(*key, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("places"), F.min("pos").alias("start"), F.max("pos").alias("last"))
    order = W.partitionBy("row", "template").orderBy("diagonal")
    apart = (F.col("phrase") | F.lag("diagonal").over(order).isNull() | (F.col("diagonal") - F.lag("diagonal").over(order) > GAP)).cast("int")
    run = F.sum("__apart").over(order.rowsBetween(W.unboundedPreceding, 0))
    votes = votes.withColumn("__apart", apart).withColumn("__run", run)
    one = W.partitionBy("row", "template", "__run")
    votes = votes.withColumn("__drift", F.col("diagonal") - F.min("diagonal").over(one))
    votes = votes.withColumn("__most", F.max("__drift").over(one))
    wide, drift = F.col("n_grams") + NOTICE_K - 1, F.col("__drift")
    bands = F.array_distinct(F.array(F.struct(F.lit(0).alias("half"), F.floor(drift / wide).alias("n")), F.struct(F.lit(1).alias("half"), F.floor((drift + wide / 2) / wide).alias("n"))))
    # a run that fits the first band is that alone
    alone = F.col("phrase") | F.col("template").isNull() | (F.col("__most") < wide)
    votes = votes.withColumn("__band", F.explode(F.when(alone, F.slice(bands, 1, 1)).otherwise(bands)))
    merged = votes.groupBy(*key, "__run", "__band").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.min("start").alias("start"), F.max("last").alias("last"))
    k = F.when(F.col("phrase"), PHRASE_K).otherwise(NOTICE_K)
    merged = merged.withColumn("cover", F.col("votes") / F.col("n_grams"))
    good = F.col("template").isNotNull() & F.when(F.col("phrase"), F.col("votes") == F.col("n_grams")).otherwise(F.col("cover") >= COVER)
    only = lambda c: F.when(good, F.col(c)).alias(c)
    return merged.select("row", *keep, "n_words", only("template"), only("phrase"), only("label"), only("start"), F.when(good, F.col("last") + k).alias("stop"), only("cover"))


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    found = spans(docs, text)
    place = F.when(F.col("phrase"), F.col("start")).cast("long")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.count(place).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        names(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"),
        names(F.col("label")).alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    ).select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
