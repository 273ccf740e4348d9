"""One query per operator, each over whole tables of the test data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.functions import chars, profile
from keysift.functions.normalize import normalize_text
from keysift.operators import evaluate as ev
from keysift.operators.detect import (
    detect,
    mask_flagged,
    match_spans,
    matches_any_rule,
    result_json,
    rule_stats,
)
from keysift.operators.encrypt import change_key, decrypt, encrypt_flagged, read_keys
from keysift.operators.examples import (
    append_examples,
    class_deficit,
    label_examples,
    label_union,
    top_up,
)
from keysift.operators.leakage import leakage_summary, leaked_rows, leaks, text_classes
from keysift.operators.profile import (
    with_char_counts,
    with_classifier_features,
    with_feature_string,
    with_profile,
)
from keysift.operators.reconcile import reconciled, reconciliation
from keysift.operators.rules import as_rules, rules_table
from keysift.operators.split import stratified_split
from keysift.operators.synth import negative_examples, positive_examples
from keysift.operators.vectorize import (
    VectorizerParams,
    fit_vocabulary,
    gram_counts,
    grams_of,
    vector_weights,
    vectorizer,
    with_features,
)
from keysift.plans import reports
from keysift.plans.config import TrainingConfig
from keysift.plans.detector import Detector, load_detector
from keysift.plans.training import fit_text_model, load_model, run_training, save_model
from keysift.session import scratch_path, spread
from keysift.sources import artifacts, files
from keysift.streaming.append import append_stream, write_batch
from keysift.streaming.detect import detect_stream, read_text_stream

Query = Callable[[SparkSession, str], DataFrame]

# Custom rules of the test queries; the oracle spells the same matches for its own engine.
CUSTOM_RULES = {"assignment": r"\w+ ?= ?\"\w+\"", "address": r"\d+\.\d+\.\d+\.\d+"}
STORED_THRESHOLD = 0.1
RULES_JSON = (
    r'{"address": {"pattern": "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+", "flags": 32},'
    r' "shout": {"pattern": "token|es[oa]s", "flags": 2}, "dollars": "[$]{3}", "ignored": 5}'
)
# The test tables are small files of one row group, read by one task each unless told otherwise.
TASKS = 8
# Texts with characters that decompose to several, or lie beyond the usual alphabets, and what is left.
UNUSUAL = {"ﬁle ½ ＡＰＩ": "file 1⁄2 api", "Ｋｅｙ № ﬃ": "key No ffi", "㎏ ² ™": "kg 2 TM"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it a file or a folder of files: a pattern that only its name fits takes both."""
    schema = table(spark, sf_dir, name).schema
    return read_text_stream(spark, f"{sf_dir}/{name}.parque[t]", schema, "*")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), TASKS)


def flat(detected: DataFrame, *keys: str) -> DataFrame:
    """Detection results without nested columns, so that engines can be compared."""
    positions = F.transform(
        "match_positions", lambda p: F.concat_ws("-", p["start"], p["end"], p["type"])
    )
    return detected.select(
        *keys,
        "has_credential",
        "confidence",
        F.array_join("matches", "\n").alias("matches"),
        F.array_join(positions, ";").alias("positions"),
    )


def digit_score(df: DataFrame) -> DataFrame:
    """A stand-in for a model that any engine can compute."""
    share = F.try_divide(chars.count_in(F.col("score_text"), "0-9"), F.length("score_text"))
    return df.withColumn("confidence", F.least(F.lit(1.0), share * F.lit(20.0)))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a stand-in class: ``(doc_id, text, label)``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return documents(spark, sf_dir).join(labels, "doc_id")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select(
        "text", (F.col("label") == 1).alias("is_credential"), F.lit("manual").alias("source")
    )


# Text profiles


def char_counts(spark, sf_dir):
    return with_char_counts(documents(spark, sf_dir)).drop("text")


def char_ratios(spark, sf_dir):
    names = ["prop_upper", "prop_lower", "prop_digit", "prop_special"]
    names += ["char_set_richness", "avg_word_length"]
    return with_profile(documents(spark, sf_dir)).select("doc_id", *names)


def shape_flags(spark, sf_dir):
    flags = profile.shape_flags(F.col("text"))
    return documents(spark, sf_dir).withColumns(flags).drop("text")


def transitions(spark, sf_dir):
    profiled = with_profile(documents(spark, sf_dir))
    return profiled.select("doc_id", "transitions", "transition_rate")


def char_class(spark, sf_dir):
    """The alphabet of the corpus: each character, its class, and how many documents have it."""
    letters = F.array_distinct(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)))
    used = documents(spark, sf_dir).select(F.explode(letters).alias("char"))
    counted = used.groupBy("char").agg(F.count("*").alias("docs"))
    return counted.withColumn("class", chars.char_class(F.col("char")))


def feature_string(spark, sf_dir):
    return with_feature_string(documents(spark, sf_dir)).drop("text")


def classifier_features(spark, sf_dir):
    return with_classifier_features(documents(spark, sf_dir)).drop("text")


def is_binary(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", profile.is_binary(F.col("text")).alias("is_binary"))


def tokenize(spark, sf_dir):
    tokens = documents(spark, sf_dir).select("doc_id", profile.tokenize(F.col("text")).alias("tokens"))
    return tokens.select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest")
    )


# Rules and detection


def rule_matches(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", matches_any_rule(F.col("text")).alias("matched"))


def match_spans_query(spark, sf_dir):
    return match_spans(documents(spark, sf_dir)).drop("text")


def spans_exploded(spark, sf_dir):
    """Positions of every chat message, with the text they cut out."""
    chat = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), TASKS)
    everything = chat.unionByName(
        documents(spark, sf_dir).select(
            F.col("doc_id").alias("conv_id"), F.lit(-1).cast("bigint").alias("turn"), "text"
        )
    )
    found = detect(everything).where("has_credential")
    spans = found.select("conv_id", "turn", "text", F.explode("match_positions").alias("p"))
    cut = F.substring("text", F.col("p.start") + 1, F.col("p.end") - F.col("p.start"))
    return spans.select("conv_id", "turn", "p.start", "p.end", "p.type", cut.alias("slice"))


def rule_stats_query(spark, sf_dir):
    return rule_stats(documents(spark, sf_dir), "doc_id")


def mask_flagged_query(spark, sf_dir):
    return mask_flagged(documents(spark, sf_dir)).drop("text")


def encrypt_flagged_query(spark, sf_dir):
    """Flagged documents sealed under one key, sealed anew under another, and opened again."""
    path = scratch_path(spark, "keys")
    ids = spark.range(2).select(F.concat(F.lit("key-"), "id").alias("key_id"))
    keys = F.unhex(F.substring(F.concat(*[F.replace(F.uuid(), F.lit("-"))] * 2), 1, 64))
    ids.withColumn("key", keys).write.parquet(path)
    docs, keys = documents(spark, sf_dir), read_keys(spark, path)
    sealed = encrypt_flagged(docs, keys, "key-0", bind=["doc_id"])
    back = decrypt(change_key(sealed, keys, "key-1", bind=["doc_id"]), keys, bind=["doc_id"])
    # Joined by id to what was sealed: is the text in the clear gone, and is it what it was once opened?
    was = docs.select("doc_id", F.md5("text").alias("was"))
    now = back.select("doc_id", F.md5("text").alias("now"), "failed")
    rows = sealed.select("doc_id", F.col("text").isNull().alias("gone"), "sealed.sealed")
    joined = rows.join(was, "doc_id").join(now, "doc_id")
    return joined.select(
        "doc_id",
        F.col("gone").alias("flagged"),
        (F.col("was").eqNullSafe(F.col("now")) & ~F.col("failed")).alias("opened"),
        F.octet_length("sealed").alias("n_bytes"),
    )


def detect_rules(spark, sf_dir):
    return flat(detect(documents(spark, sf_dir)), "doc_id")


def detect_custom_rules(spark, sf_dir):
    return flat(detect(documents(spark, sf_dir), rules=CUSTOM_RULES), "doc_id")


def detect_hybrid(spark, sf_dir):
    return flat(detect(documents(spark, sf_dir), score=digit_score), "doc_id")


def detect_json(spark, sf_dir):
    """Results as JSON lines, written and read back."""
    path = scratch_path(spark, "results")
    result_json(detect(documents(spark, sf_dir))).write.text(path)
    schema = "text STRING, has_credential BOOLEAN, confidence DOUBLE, matches ARRAY<STRING>"
    back = spark.read.schema(schema).json(path)
    return back.groupBy("has_credential", "confidence").agg(
        F.count("*").alias("n"),
        F.sum(F.length("text")).alias("chars"),
        F.sum(F.size("matches")).alias("matches"),
    )


def rules_from_json(spark, sf_dir):
    """Scan with rules read from JSON text; matches per document and rule."""
    path = scratch_path(spark, "patterns")
    spark.createDataFrame([(RULES_JSON,)], "value STRING").coalesce(1).write.text(path)
    found = match_spans(documents(spark, sf_dir), rules=artifacts.read_rules(spark, path))
    return found.select("doc_id", "rule_order", "type", "start", "end")


def export_rules(spark, sf_dir):
    """The rules that hit the corpus, exported as one JSON object."""
    hit = match_spans(documents(spark, sf_dir)).select(F.col("type").alias("rule"))
    return artifacts.rules_json(rules_table(spark).join(hit, "rule", "left_semi"))


def detect_from_artifacts(spark, sf_dir):
    """Store rules and a threshold other than the default, load a detector from the folder, and run it
    with a score that the threshold decides on."""
    folder = scratch_path(spark, "artifacts")
    paths = artifacts.ArtifactPaths.of(folder)
    artifacts.write_rules(rules_table(spark), paths.patterns)
    vocabulary = spark.createDataFrame([("abc", 0, 1.0)], "gram STRING, idx INT, idf DOUBLE")
    settings = artifacts.config_json(vocabulary, {}, rules_table(spark), threshold=STORED_THRESHOLD)
    artifacts.write_config(settings, paths.config)
    loaded = load_detector(spark, folder)
    found = detect(documents(spark, sf_dir), "text", loaded.rules, digit_score, loaded.threshold)
    return flat(found, "doc_id")


def detect_stream_query(spark, sf_dir):
    """Detection over chat messages as a stream, run until the folder is read."""
    stream = streamed(spark, sf_dir, "conversations")
    output = scratch_path(spark, "stream")
    query = detect_stream(
        stream, output, scratch_path(spark, "stream-state"), score=digit_score, available_now=True
    )
    query.awaitTermination()
    return flat(spark.read.parquet(output), "conv_id", "turn")


# Files


def ingest_jsonl(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    rows = examples(spark, sf_dir)
    append_examples(rows.where("is_credential"), f"{path}/yes")
    append_examples(rows.where("NOT is_credential"), f"{path}/no")
    return files.load_examples(spark, f"{path}/yes", f"{path}/no")


def _damaged_lines(spark, sf_dir) -> DataFrame:
    """A JSONL line per document: French ones with a second object glued on, German ones with
    broken text glued on, Spanish ones inside blanks."""
    docs = spread(table(spark, sf_dir, "documents"), TASKS)
    line = F.to_json(
        F.struct("text", F.lit(True).alias("is_credential"), F.col("source").alias("source"))
    )
    second = F.to_json(F.struct(F.col("lang").alias("text"), F.lit(False).alias("is_credential")))
    return docs.select(
        "doc_id",
        F.when(F.col("lang") == "fr", F.concat(line, second))
        .when(F.col("lang") == "de", F.concat(line, F.lit('{"text": ')))
        .when(F.col("lang") == "es", F.concat(F.lit(" \t"), line, F.lit(" ")))
        .otherwise(line)
        .alias("value"),
    )


def ingest_jsonl_repair(spark, sf_dir):
    parsed = files.parse_jsonl(_damaged_lines(spark, sf_dir))
    return parsed.select(
        "doc_id",
        F.col("entry.text").alias("text"),
        F.col("entry.is_credential").try_cast("boolean").alias("is_credential"),
        F.when(F.col("entry.text").isNull(), F.col("piece")).alias("rejected"),
    )


def ingest_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    docs = spread(table(spark, sf_dir, "documents"), TASKS)
    label = F.when(F.col("lang") == "es", F.lit("")).otherwise((F.col("n_chars") % 3 - 1).cast("string"))
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    # A French document is a row that ends after the text, a Spanish one has an empty label.
    line = F.when(F.col("lang") == "fr", quoted).otherwise(F.concat_ws(",", quoted, label, F.col("lang")))
    docs.select(line.alias("value")).write.text(path)
    return files.read_csv(spark, path, has_header=False)


def ingest_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    documents(spark, sf_dir).select("text").write.text(path)
    rows = files.read_line_examples(spark, path, False)
    named = F.col("source").startswith("file:part-").alias("named")
    return rows.groupBy("text", "is_credential", named).agg(F.count("*").alias("n"))


def ingest_testset(spark, sf_dir):
    """A test object per document, one text per line of it, labelled by whether it has a digit."""
    path = scratch_path(spark, "testset")
    texts = F.split("text", "\n")
    labels = F.transform(texts, lambda t: t.rlike("[0-9]").cast("int"))
    sets = documents(spark, sf_dir).select(texts.alias("texts"), labels.alias("labels"))
    sets.write.json(path)
    rows = files.read_testset(spark, path, multiline=False)
    return rows.groupBy("pos", "text", "label").agg(F.count("*").alias("n"))


def ingest_testset_object(spark, sf_dir):
    """All documents as one test object, labelled by whether they have a digit, written by many tasks in files
    that follow each other, read by blocks."""
    path = scratch_path(spark, "testset-object")
    docs = documents(spark, sf_dir)
    label = F.col("text").rlike("[0-9]").cast("int")
    # A string is the first value of an array, and what the JSON writer makes of that has no line breaks.
    value = F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1)
    line = F.concat(F.lit(", "), value).alias("value")
    parts = [
        docs.limit(1).select(F.lit(0).alias("part"), F.lit(0).alias("doc_id"), F.lit('{"texts": [null').alias("value")),
        docs.select(F.lit(1).alias("part"), "doc_id", line),
        docs.limit(1).select(F.lit(2).alias("part"), F.lit(0).alias("doc_id"), F.lit('], "labels": [null').alias("value")),
        docs.select(F.lit(3).alias("part"), "doc_id", F.concat(F.lit(", "), label).alias("value")),
        docs.limit(1).select(F.lit(4).alias("part"), F.lit(0).alias("doc_id"), F.lit("]}").alias("value")),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    lines.orderBy("part", "doc_id").select("value").write.text(path)
    return files.read_testset(spark, path, in_parts=True)


def append_examples_query(spark, sf_dir):
    """Two labelled batches appended to the same folder."""
    path = scratch_path(spark, "append")
    append_examples(label_examples(documents(spark, sf_dir), False), path)
    chat = spread(table(spark, sf_dir, "conversations"), TASKS)
    append_examples(label_examples(chat, True, "user_input"), path)
    return files.read_jsonl(spark, path)


def append_stream_query(spark, sf_dir):
    """Chat messages as a stream appended to a JSONL table, and its first batch written once more."""
    stream = streamed(spark, sf_dir, "conversations")
    path = scratch_path(spark, "append-stream")
    append_stream(
        stream, path, scratch_path(spark, "append-state"), True, "chat", "user_input", available_now=True
    ).awaitTermination()
    chat = spread(table(spark, sf_dir, "conversations"), TASKS)
    write_batch(label_examples(chat, True, "user_input"), 0, path, "chat")
    return files.read_jsonl(spark, path)


# Labelled data


def label_union_query(spark, sf_dir):
    rows = examples(spark, sf_dir)
    return label_union(rows.where("is_credential"), rows.where("NOT is_credential"))


def class_deficit_query(spark, sf_dir):
    return class_deficit(examples(spark, sf_dir), min_examples=500)


def topup_examples(spark, sf_dir):
    """Top both classes up to as many rows as there are labels."""
    labels = table(spark, sf_dir, "labels").count()
    return top_up(examples(spark, sf_dir), min_examples=labels)


def synth_positive(spark, sf_dir):
    return positive_examples(documents(spark, sf_dir).select("doc_id"), "doc_id")


def synth_negative(spark, sf_dir):
    return negative_examples(documents(spark, sf_dir).select("doc_id"), "doc_id")


def stratified_split_query(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return stratified_split(labels, "doc_id")


def split_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "split")
    files.write_split(stratified_split(labelled(spark, sf_dir), "doc_id"), path)
    return files.read_split(spark, path)


def _split_texts(spark, sf_dir) -> DataFrame:
    return stratified_split(labelled(spark, sf_dir), "doc_id")


def leakage_audit(spark, sf_dir):
    """Test documents whose text is in the training part, and how often under which label."""
    found = leaked_rows(_split_texts(spark, sf_dir))
    return found.select("doc_id", "label", "leak.*")


def leakage_classes(spark, sf_dir):
    return leaks(text_classes(_split_texts(spark, sf_dir)))


def leakage_summary_query(spark, sf_dir):
    summary = leakage_summary(text_classes(_split_texts(spark, sf_dir)))
    return summary.withColumn("share", F.round("share", 6))


# Vectors


def normalize_text_query(spark, sf_dir):
    """All documents, each followed by texts that need the full decomposition."""
    suffix = F.create_map(*[F.lit(x) for i, text in enumerate(UNUSUAL) for x in (i, text)])
    text = F.concat("text", suffix[(F.col("doc_id") % len(UNUSUAL)).cast("int")])
    return documents(spark, sf_dir).select("doc_id", normalize_text(text).alias("text"))


def char_wb_ngrams(spark, sf_dir):
    """All grams of a document in order, as their number and a digest."""
    grams = grams_of(F.col("text"), VectorizerParams())
    listed = documents(spark, sf_dir).select("doc_id", F.sort_array(grams).alias("grams"))
    return listed.select(
        "doc_id", F.size("grams").alias("n"), F.md5(F.array_join("grams", "|")).alias("digest")
    )


def gram_counts_query(spark, sf_dir):
    return gram_counts(documents(spark, sf_dir))


def tfidf_fit(spark, sf_dir):
    return fit_vocabulary(documents(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


def tfidf_transform(spark, sf_dir):
    docs = documents(spark, sf_dir)
    vectors = with_features(docs, vectorizer(fit_vocabulary(docs)))
    return vector_weights(vectors, ["doc_id"]).withColumn("weight", F.round("weight", 6))


def _stored_vocabulary(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "vocabulary")
    artifacts.write_vocabulary(fit_vocabulary(documents(spark, sf_dir)), path)
    return artifacts.read_vocabulary(spark, path)[0]


def vocab_from_json(spark, sf_dir):
    return _stored_vocabulary(spark, sf_dir).withColumn("idf", F.round("idf", 6))


def export_vocab(spark, sf_dir):
    """The grams of the exported object in order, and its settings."""
    json = artifacts.vocabulary_json(fit_vocabulary(documents(spark, sf_dir)))
    schema = "vocabulary MAP<STRING,INT>, ngram_range ARRAY<INT>, norm STRING, max_df DOUBLE, analyzer STRING"
    v = json.select(F.from_json("value", schema).alias("v")).select("v.*")
    return v.select(
        F.md5(F.array_join(F.map_keys("vocabulary"), "|")).alias("digest"),
        F.size("vocabulary").alias("n"),
        F.array_join("ngram_range", "-").alias("ngram_range"),
        "norm",
        "max_df",
        "analyzer",
    )


def raw_vector_without_idf(spark, sf_dir):
    """Raw vectors from a vectoriser file that has no idf: every gram weighs 1."""
    docs, path = documents(spark, sf_dir), scratch_path(spark, "vocabulary")
    json = artifacts.vocabulary_json(fit_vocabulary(docs))
    plain = F.regexp_replace("value", r'"idf":\[[^\]]*\],', "")
    json.select(plain.alias("value")).coalesce(1).write.text(path)
    vectors = with_features(docs, vectorizer(artifacts.read_vocabulary(spark, path)[0], "raw"), mode="raw")
    return vector_weights(vectors, ["doc_id"]).withColumn("weight", F.round("weight", 6))


def export_config(spark, sf_dir):
    vocabulary = fit_vocabulary(documents(spark, sf_dir))
    config = TrainingConfig().as_dict()
    json = artifacts.config_json(vocabulary, config, rules_table(spark), "detector")
    schema = """model_name STRING, input_dim INT, feature_names ARRAY<STRING>, confidence_threshold DOUBLE,
        patterns MAP<STRING,STRING>, config MAP<STRING,STRING>"""
    c = json.select(F.from_json("value", schema).alias("c")).select("c.*")
    maps = {
        name: F.array_join(
            F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat_ws("=", e["key"], e["value"])),
            "|",
        )
        for name in ("patterns", "config")
    }
    return c.withColumns({"feature_names": F.array_join("feature_names", "|"), **maps})


def raw_ngram_vector(spark, sf_dir):
    docs = documents(spark, sf_dir)
    vectors = with_features(docs, vectorizer(_stored_vocabulary(spark, sf_dir), "raw"), mode="raw")
    return vector_weights(vectors, ["doc_id"]).withColumn("weight", F.round("weight", 6))


# Evaluation: the stand-in score against a stand-in label


def _scored(spark, sf_dir) -> DataFrame:
    """Detection first, so that the join with the labels moves no texts."""
    found = detect(documents(spark, sf_dir), score=digit_score)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return found.select("doc_id", "has_credential", "confidence").join(labels, "doc_id")


def _counts(spark, sf_dir) -> DataFrame:
    return ev.score_counts(_scored(spark, sf_dir), "label", "has_credential", "confidence")


def eval_confusion(spark, sf_dir):
    return ev.confusion(_counts(spark, sf_dir))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def eval_report(spark, sf_dir):
    return _rounded(ev.report(_counts(spark, sf_dir)), "precision", "recall", "f1")


def eval_summary(spark, sf_dir):
    result = ev.evaluate(_scored(spark, sf_dir))
    return _rounded(result.summary, "accuracy", "f1", "roc_auc")


def eval_joined(spark, sf_dir):
    """Detections and labels as two tables: some documents predicted twice, some of those against
    themselves, some labels of other documents, some rows without a key."""
    found = detect(documents(spark, sf_dir), score=digit_score).select("doc_id", "has_credential", "confidence")
    again = found.where("doc_id % 7 = 0").withColumn(
        "has_credential", F.when(F.col("doc_id") % 2 == 0, ~F.col("has_credential")).otherwise(F.col("has_credential"))
    )
    keyless = found.where("doc_id % 10 = 3").withColumn("doc_id", F.lit(None).cast("long"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    strange = labels.where("doc_id % 5 = 0").withColumn("doc_id", -1 - F.col("doc_id"))
    predictions = found.where("doc_id % 10 <> 3").union(again).union(keyless)
    return reconciliation(reconciled(predictions, labels.union(labels.where("doc_id % 4 = 0")).union(strange), "doc_id"))


def pr_curve(spark, sf_dir):
    points = ev.curve_points(_counts(spark, sf_dir))
    return _rounded(ev.pr_curve(points), "threshold", "precision", "recall")


def roc_curve(spark, sf_dir):
    points = ev.curve_points(_counts(spark, sf_dir))
    curve = ev.roc_curve(points).withColumn(
        "threshold", F.when(F.col("threshold") < float("inf"), F.col("threshold"))
    )
    return _rounded(curve, "threshold", "fpr", "tpr")


def auc(spark, sf_dir):
    return _rounded(ev.auc(ev.curve_points(_counts(spark, sf_dir))), "auc")


# Model


def _measures(matrix: DataFrame) -> DataFrame:
    """``(class, precision, recall, f1, support)`` of a confusion matrix, by joins of its margins: the same
    measures as the report's, computed another way."""
    hits = matrix.where("label = prediction").select("label", F.col("n").alias("hit"))
    real = matrix.groupBy("label").agg(F.sum("n").alias("support"))
    claimed = matrix.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("claimed"))
    rows = hits.join(real, "label").join(claimed, "label")
    rows = rows.withColumns(
        {
            "precision": F.coalesce(F.try_divide("hit", "claimed"), F.lit(0.0)),
            "recall": F.coalesce(F.try_divide("hit", "support"), F.lit(0.0)),
        }
    )
    both = F.col("precision") + F.col("recall")
    rows = rows.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), F.lit(0.0)))
    names = F.array(*[F.lit(name) for name in ev.CLASS_NAMES])
    per_class = rows.select(F.get(names, F.col("label")).alias("class"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    summed = [
        rows.agg(
            F.lit("accuracy").alias("class"),
            F.lit(None).cast("double").alias("precision"),
            F.lit(None).cast("double").alias("recall"),
            (F.sum("hit") / total).alias("f1"),
            total.alias("support"),
        ),
        rows.agg(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in MEASURES], total.alias("support")),
        rows.agg(
            F.lit("weighted avg").alias("class"),
            *[(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in MEASURES],
            total.alias("support"),
        ),
    ]
    return per_class.union(summed[0]).union(summed[1]).union(summed[2])


MEASURES = ("precision", "recall", "f1")


def train_forest(spark, sf_dir):
    """Train on the labelled documents and report on the held-out share: the support of each class, and
    whether each measure is what follows from the confusion matrix. Which trees grow is the library's choice."""
    result = run_training(labelled(spark, sf_dir), key="doc_id")
    own = _measures(result.confusion()).withColumnsRenamed({m: f"own_{m}" for m in (*MEASURES, "support")})
    rows = result.report().join(own, "class", "left")
    sound = F.col("support") == F.col("own_support")
    for m in MEASURES:
        same = F.abs(F.col(m) - F.col(f"own_{m}")) < 1e-9
        sound = sound & F.coalesce(same, F.col(m).isNull() & F.col(f"own_{m}").isNull())
    return rows.select("class", "support", F.coalesce(sound, F.lit(False)).alias("sound"))


def train_report(spark, sf_dir):
    """The lines of the report: headings and settings as they stand; of each line with numbers, whether
    these follow from the confusion matrix."""
    result = run_training(labelled(spark, sf_dir), key="doc_id")
    lines = [line for line in result.report_lines() if line.strip()]
    written = spark.createDataFrame(list(enumerate(lines)), "n INT, line STRING")
    matrix = result.confusion()
    own = _measures(matrix)

    def shown(value):
        return F.when(value.isNull(), "").otherwise(F.format_string("%.2f", value))

    # As words, without the blanks that line them up.
    per_class = own.select(
        F.col("class").alias("name"),
        F.concat_ws(" ", "class", *[shown(F.col(m)) for m in MEASURES], F.col("support").cast("string")).alias("words"),
    )
    total = own.where("class = 'accuracy'").select(
        F.lit("total").alias("name"), F.concat(F.lit(reports.ACCURACY), F.col("f1").cast("string")).alias("words")
    )
    cells = matrix.groupBy("label").pivot("prediction", [0, 1]).agg(F.first("n"))
    rows = cells.select(
        F.concat(F.lit("matrix row "), "label").alias("name"), F.concat_ws(" ", "0", "1").alias("words")
    )
    expected = per_class.union(total).union(rows)
    expected = expected.withColumn("words", F.trim(F.regexp_replace("words", " +", " ")))
    # A row of the matrix stands in brackets.
    bare = F.trim(F.regexp_replace(F.regexp_replace("line", r"[\[\]]", " "), " +", " "))
    checked = expected.join(written.withColumn("words", bare), "words", "left").groupBy("name").agg(
        F.count("n").alias("found")
    )
    names = F.concat("name", F.lit(": "), (F.col("found") > 0).cast("string"))
    kept = [reports.REPORT, reports.MATRIX, reports.SETTINGS]
    settings = written.where((F.col("n") > lines.index(reports.SETTINGS)) | F.col("line").isin(kept))
    return settings.select(F.col("line").alias("value")).union(checked.select(names))


def score_model(spark, sf_dir):
    """Rules first, forest second, over all documents: what the rules find, and whether the rest has a
    confidence from 0 to 1 that decides."""
    model = fit_text_model(labelled(spark, sf_dir), TrainingConfig())
    detector = Detector(as_rules(None), model)
    found = detector.detect(documents(spark, sf_dir))
    hit = F.size("match_positions") > 0
    over = F.col("confidence") >= detector.threshold
    text_itself = F.when(over, F.array("text")).otherwise(F.array().cast("array<string>"))
    decided = (F.col("has_credential") == over) & F.col("confidence").between(0, 1)
    decided = decided & (hit | (F.col("matches") == text_itself))
    return flat(found.withColumns({"rule_hit": hit, "sound": decided}), "doc_id", "rule_hit", "sound").select(
        "doc_id", "rule_hit", "sound", F.when(F.col("rule_hit"), F.col("matches")).alias("matches"), "positions"
    )


def model_roundtrip(spark, sf_dir):
    """Whether scores are the same before and after storing the model."""
    result = run_training(labelled(spark, sf_dir), key="doc_id")
    folder = scratch_path(spark, "model")
    save_model(result, folder)
    docs = documents(spark, sf_dir)
    before = result.model.predict(docs).select("doc_id", F.col("confidence").alias("before"))
    after = load_model(spark, folder).predict(docs).select("doc_id", F.col("confidence").alias("after"))
    same = (F.col("before") == F.col("after")).alias("same")
    return before.join(after, "doc_id").select("doc_id", same)


def profile_model_roundtrip(spark, sf_dir):
    """Whether a model with the profile of texts in its vectors scores the same after storing, and the
    profile is a part of its vectors."""
    config = TrainingConfig(rf_n_estimators=20, rf_max_depth=8)
    result = run_training(labelled(spark, sf_dir), config, key="doc_id", assemble_profile=True)
    folder = scratch_path(spark, "profile-model")
    save_model(result, folder)
    loaded = load_model(spark, folder)
    docs = documents(spark, sf_dir)
    longer = loaded.forest.numFeatures - result.model.vocabulary.count()
    before = result.model.predict(docs).select("doc_id", F.col("confidence").alias("before"))
    after = loaded.predict(docs).select("doc_id", F.col("confidence").alias("after"))
    same = (F.col("before") == F.col("after")) & F.col("after").between(0, 1)
    return before.join(after, "doc_id").select("doc_id", same.alias("same"), F.lit(longer).alias("n_profile"))


QUERIES: dict[str, Query] = {
    "char_counts": char_counts,
    "char_ratios": char_ratios,
    "shape_flags": shape_flags,
    "transitions": transitions,
    "char_class": char_class,
    "feature_string": feature_string,
    "classifier_features": classifier_features,
    "is_binary": is_binary,
    "tokenize": tokenize,
    "rule_matches": rule_matches,
    "match_spans": match_spans_query,
    "spans_exploded": spans_exploded,
    "rule_stats": rule_stats_query,
    "mask_flagged": mask_flagged_query,
    "encrypt_flagged": encrypt_flagged_query,
    "detect_rules": detect_rules,
    "detect_custom_rules": detect_custom_rules,
    "detect_hybrid": detect_hybrid,
    "detect_json": detect_json,
    "rules_from_json": rules_from_json,
    "export_rules": export_rules,
    "detect_from_artifacts": detect_from_artifacts,
    "detect_stream": detect_stream_query,
    "ingest_jsonl": ingest_jsonl,
    "ingest_jsonl_repair": ingest_jsonl_repair,
    "ingest_csv": ingest_csv,
    "ingest_lines": ingest_lines,
    "ingest_testset": ingest_testset,
    "ingest_testset_object": ingest_testset_object,
    "append_examples": append_examples_query,
    "append_stream": append_stream_query,
    "label_union": label_union_query,
    "class_deficit": class_deficit_query,
    "topup_examples": topup_examples,
    "synth_positive": synth_positive,
    "synth_negative": synth_negative,
    "stratified_split": stratified_split_query,
    "split_roundtrip": split_roundtrip,
    "leakage_audit": leakage_audit,
    "leakage_classes": leakage_classes,
    "leakage_summary": leakage_summary_query,
    "normalize_text": normalize_text_query,
    "char_wb_ngrams": char_wb_ngrams,
    "gram_counts": gram_counts_query,
    "tfidf_fit": tfidf_fit,
    "tfidf_transform": tfidf_transform,
    "vocab_from_json": vocab_from_json,
    "export_vocab": export_vocab,
    "export_config": export_config,
    "raw_ngram_vector": raw_ngram_vector,
    "raw_vector_without_idf": raw_vector_without_idf,
    "eval_confusion": eval_confusion,
    "eval_report": eval_report,
    "eval_summary": eval_summary,
    "eval_joined": eval_joined,
    "pr_curve": pr_curve,
    "roc_curve": roc_curve,
    "auc": auc,
    "train_forest": train_forest,
    "train_report": train_report,
    "score_model": score_model,
    "model_roundtrip": model_roundtrip,
    "profile_model_roundtrip": profile_model_roundtrip,
}
