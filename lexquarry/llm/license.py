r"""License scans by diagonal voting, in DataFrame functions only.

Templates are license phrases (base: every place counts, word for word) and longer notices (found also when
worded a little differently). All rolling k-word hashes of a document are joined to the templates' positions
(the template table is fixed and small, so it is broadcast; hashes that no template holds leave before the
join). A match of document word p and template word t votes for the diagonal p - t. A phrase stands where
one diagonal has all its grams. For notices neighbouring diagonals, as insertions and deletions make them,
are merged, and the merged span is verified: it must hold enough distinct template grams, in a stretch not
much longer than the template. The join is by hash; the words are compared beside it.

Cases. Null and empty texts have no words, no places and null first and last words. Rows are judged one by
one, whatever their ids; other columns are kept if carried. A-Z only is lower-cased: a gram counts only if
it is ASCII as it stands. An empty table gives none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 3
# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Opening sentences of well-known notices, as words, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2",
    "this work is licensed under a creative commons attribution noncommercial": "cc-by-nc",
}
# The wording of short licenses in full, without titles and copyright lines, and their labels.
TEXTS = {
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
    Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
    and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
    included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
    LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
    CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
    DEALINGS IN THE SOFTWARE.""": "mit",
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of
    source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
    copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS
    PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY
    AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
    EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
    HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
    SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""": "bsd",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
    permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
    WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
    RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
    PERFORMANCE OF THIS SOFTWARE.""": "isc",
    """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
    software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
    the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software
    in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must
    not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""": "zlib",
    """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
    source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""": "unlicense",
    """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
    ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""": "apache-2",
    """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
    PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.""": "gpl",
}
#: Diagonals of a notice count from so many grams on: what a chance phrase shares with it is less.
LEAST_VOTES = 2
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def scan_licenses(docs: DataFrame, *, text_col: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, drift: int = 4, enough: float = 0.6, carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns `carry` of each document, _n_words, _n_base, _first_word, _last_word, _base_labels, _labels, _score.

    drift: how far apart diagonals may lie to be merged; enough: the share of a notice's grams that must be found.
    """
    spark = docs.sparkSession
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES | TEXTS if notices is None else notices
    rows = []
    for n, (text, label, base) in enumerate([*((t, v, True) for t, v in phrases.items()), *((t, v, False) for t, v in notices.items())]):
        words = template_words(text)
        if len(words) < K:
            raise ValueError(f"a template needs {K} words")
        rows += [(n, label, base, len(words), len(words) - K + 1, at, " ".join(words[at : at + K])) for at in range(len(words) - K + 1)]
    templates = spark.createDataFrame(rows, "template int, label string, base boolean, size int, grams int, at int, words string")
    templates = templates.withColumn("hash", _hash(F.split("words", " "), F.lit(0)))
    known = [r["hash"] for r in templates.select("hash").distinct().collect()]  # a number for each gram of the templates

    kept = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    words = docs.select(F.monotonically_increasing_id().alias("row"), *kept, F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), _SPLIT), lambda w: w != "").alias("words"))
    low = F.transform("words", F.lower)
    sized = words.select("row", *(f"_c{i}" for i in range(len(carry))), "words", F.size("words").alias("n"), low.alias("low"))
    places = F.when(F.col("n") >= K, F.filter(F.sequence(F.lit(0), F.greatest(F.col("n") - K, F.lit(0))), lambda i: _hash(F.col("low"), i).isin(known)))
    met = sized.withColumn("places", places).select("row", *(f"_c{i}" for i in range(len(carry))), "n", F.transform("places", lambda i: F.struct(i.alias("place"), _hash(F.col("low"), i).alias("hash"), F.array_join(F.slice("words", i + 1, K), " ").alias("raw"))).alias("met"))
    each = met.select("row", *(f"_c{i}" for i in range(len(carry))), "n", F.explode_outer("met").alias("m")).select("row", *(f"_c{i}" for i in range(len(carry))), "n", "m.place", "m.hash", F.when(F.col("m.raw").rlike(r"\A[\x00-\x7F]*\z"), F.lower("m.raw")).alias("gram"))
    # the words are compared with the template's, so no two grams of one hash are taken for each other
    votes = each.join(F.broadcast(templates.withColumnRenamed("hash", "of")), (F.col("hash") == F.col("of")) & (F.col("gram") == F.col("words")), "left").repartition("row")
    by_row = ["row", *(f"_c{i}" for i in range(len(carry))), "n"]
    diagonals = votes.groupBy(*by_row, "template", "label", "base", "size", "grams", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.min("place").alias("low"), F.max("place").alias("high"))
    # those of too few votes stay as rows without a template, so that no document is lost
    enough_votes = F.col("base") | (F.size("ats") >= F.least(F.lit(LEAST_VOTES), "grams"))
    diagonals = diagonals.select(*by_row, *(F.when(enough_votes, F.col(c)).alias(c) for c in ("template", "label", "base", "size", "grams", "diagonal", "ats", "low", "high")))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > drift), F.lit(True))
    islands = diagonals.withColumn("island", F.sum(apart.cast("int")).over(order))
    spans = islands.groupBy(*by_row, "template", "label", "base", "size", "grams", "island").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("start"))
    share = F.col("votes") / F.col("grams")
    place = F.col("base") & (F.col("votes") == F.col("grams"))
    notice = ~F.col("base") & (share >= enough) & (F.col("high") - F.col("low") + K <= 1.5 * F.col("size"))
    found = spans.groupBy(*by_row).agg(
        F.count_if(place).alias("_n_base"),
        F.min(F.when(place, F.col("start"))).cast("long").alias("_first_word"),
        F.max(F.when(place, F.col("start"))).cast("long").alias("_last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(place, F.col("label")))), ",").alias("_base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(place | notice, F.col("label")))), ",").alias("_labels"),
        F.coalesce(F.max(F.when(share < 1, share).when(share >= 1, 1.0)), F.lit(0.0)).alias("_score"),
    )
    return found.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), F.col("n").cast("long").alias("_n_words"), "_n_base", "_first_word", "_last_word", "_base_labels", "_labels", "_score")


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _hash(words: Column, at: Column) -> Column:
    return F.xxhash64(*(F.get(words, at + i) for i in range(K)))
