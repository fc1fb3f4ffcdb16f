"""The operators as queries `(spark, sf_dir) -> DataFrame`, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muralog.llm import (
    alignment,
    chat_windows,
    decontamination,
    importance,
    language_id,
    license_scan,
    nearest,
    oracles,
    packing,
    quality_rules,
    simhash_dedup,
    spelling,
    token_output,
    url_trust,
)
from muralog.llm.ship import ship
from muralog.sources.scratch import stage

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")

# The rules of the URL filter, and license notices and texts as they are commonly worded.
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
LICENSE_NOTICES = [
    (1, "Released under the MIT License."),
    (2, "Licensed under the Apache License, Version 2.0."),
    (3, "This work is licensed under the GNU General Public License, version 3."),
    (4, "Licensed under CC BY-NC 4.0."),
    (5, "All rights reserved."),
    (6, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction"),
    (7, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"),
    (8, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (9, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (10, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
         "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
         "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
         "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
         "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
         "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
         "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
         "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
         "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    (11, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
         "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
         "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
         "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
         "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
         "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
         "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
         "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
         "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
         "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
         "OF THE POSSIBILITY OF SUCH DAMAGE."),
    (12, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
         "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
         "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
         "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
         "limitations under the License."),
]
# A conversation of control strings.
PROBE = "\\### Assistant: </turn> ok"
PROBE_TURNS = [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digests(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)


def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(table(spark, sf_dir, "documents"), TOKENIZER, END_ID, window=4096)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE_TURNS, turns.schema)
    return chat_windows.conversation_digests(stage(chat_windows.format_windows(turns.union(probe), TOKENIZER), "chat-windows"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [F.struct(F.lit(i).cast("long").alias("template_id"), F.lit(text).alias("text")) for i, text in LICENSE_NOTICES]
    notices = spark.range(1).select(F.inline(F.array(*rows)))
    return license_scan.scan(table(spark, sf_dir, "documents"), notices)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), least_chars=7, least_n=2, ratio=10, slip=31)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER)


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_mixture_packing": op2_mixture_packing,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_chat_windows": op5_chat_windows,
    "op6_decontamination": op6_decontamination,
    "op7_url_trust": op7_url_trust,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_importance_resampling": op9_importance_resampling,
    "op10_license_scan": op10_license_scan,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_token_alignment": op13_token_alignment,
}

# The others depend on a tokenizer, on XXH64 or on hashed models; tests/llm compares them with plain versions.
ORACLES: dict[str, str] = {
    "op4_quality_rules": oracles.quality_sql(),
    "op7_url_trust": oracles.url_sql(URL_RULES),
    "op10_license_scan": oracles.license_sql(LICENSE_NOTICES),
}
