"""Checkpoints, metrics and parameter tables of training runs, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N


def matched_keys(model: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """(key, state): loaded, missing (in the model alone) or unexpected (in the checkpoint alone)."""
    m, c = model.select("key").distinct().withColumn("__m", F.lit(True)), checkpoint.select("key").distinct().withColumn("__c", F.lit(True))
    return m.join(c, "key", "full").select("key", F.when(F.col("__m") & F.col("__c"), "loaded").when(F.col("__m"), "missing").otherwise("unexpected").alias("state"))


def suffix_matches(keys: DataFrame, model: DataFrame) -> DataFrame:
    """(key, model_key): for each key the model key it is, else the only one that ends in one of its dotted tails, longest first.

    A tail begins behind a dot of the key, and may begin anywhere in the model key. The key itself is tried first, then with
    the adapter's wrapper, then without. Model keys list all their endings, so this is an equi-join; a model has some
    thousand keys of bounded length.
    """
    k = F.col("key")
    ways = F.explode(F.array(*[F.struct(F.lit(i).alias("way"), x.alias("k")) for i, x in enumerate((k, N.wrapped(k), N.unwrapped(k)))]))
    tried = keys.select("key").distinct().select("key", ways.alias("w")).select("key", "w.way", "w.k", F.split("w.k", r"\.").alias("p"))
    tails = tried.select("key", "way", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", n, F.size("p")), "."))).alias("start", "tail"))
    whole = model.select(F.col("key").alias("model_key")).distinct()
    size = F.length("model_key")
    ends = whole.select("model_key", F.explode(F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.col("model_key"), i, size))).alias("tail"))
    only = ends.groupBy("tail").agg(F.count("*").alias("n"), F.min("model_key").alias("model_key")).where("n = 1")
    hits = tails.where("start > 0").join(only, "tail").select("key", "way", "start", "model_key")
    same = tails.where("start = 0").join(whole, F.col("tail") == F.col("model_key")).select("key", "way", "start", "model_key")
    return hits.unionByName(same).groupBy("key").agg(F.min_by("model_key", F.struct("way", "start")).alias("model_key"))


def rewritten(model: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """(ord, name, key, new_key): every checkpoint key under each of the 55 rewrites, i.e. eleven changes of the prefix times five of the wrapper."""
    key = F.col("key")
    changes = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), c.alias("k")) for i, (name, c) in enumerate(N.prefix_changes(key))]))
    base = checkpoint.select("key").distinct().select("key", changes.alias("c")).select("key", "c.i", "c.name", "c.k")
    names = model.select(F.col("key").alias("known")).distinct()
    forms = base.withColumns({"w": N.wrapped(F.col("k")), "u": N.unwrapped(F.col("k"))})
    for c in ("k", "w", "u"):
        forms = forms.join(names.select(F.col("known").alias(f"in_{c}")), F.col(c) == F.col(f"in_{c}"), "left")
    found = suffix_matches(base.select(F.col("k").alias("key")), model).select(F.col("key").alias("k"), F.col("model_key").alias("by_tail"))
    forms = forms.join(found, "k", "left")
    ways = [("identity", F.col("k")), ("insert adapter module wrapper", F.col("w")), ("remove adapter module wrapper", F.col("u")), ("prefer existing adapter module wrapper", F.coalesce("in_k", "in_w", "in_u", "k")), ("unique suffix match", F.coalesce("by_tail", "k"))]
    each = forms.select("key", "i", "name", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(n).alias("way"), c.alias("new_key")) for j, (n, c) in enumerate(ways)])).alias("x"))
    name = F.when(F.col("x.j") == 0, F.col("name")).when(F.col("i") == 0, F.col("x.way")).otherwise(F.concat("name", F.lit(" + "), F.col("x.way")))
    return each.select((F.col("i") * 5 + F.col("x.j")).alias("ord"), name.alias("name"), "key", F.col("x.new_key").alias("new_key"))


def transforms(model: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """(ord, name, matched): how many checkpoint keys each rewrite turns into model keys."""
    hits = rewritten(model, checkpoint).join(model.select(F.col("key").alias("known"), F.lit(1).alias("hit")).distinct(), F.col("new_key") == F.col("known"), "left")
    return hits.groupBy("ord", "name").agg(F.count("hit").alias("matched"))


def best_transform(model: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """(name, matched) of the rewrite that matches most, the earliest on ties."""
    best = transforms(model, checkpoint).groupBy().agg(F.max_by(F.struct("name", "matched"), F.struct(F.col("matched"), -F.col("ord"))).alias("x"))
    return best.select("x.name", "x.matched").where("name IS NOT NULL")


def load_report(model: DataFrame, checkpoint: DataFrame, name: str, *, examples: int = 5) -> DataFrame:
    """(state, keys, examples): loaded and missing model keys and unexpected checkpoint keys under a rewrite, with the first few of each."""
    new = rewritten(model, checkpoint).where(F.col("name") == name).select("key", "new_key")
    known = model.select(F.col("key").alias("new_key")).distinct()
    loaded = new.select("new_key").distinct().join(known, "new_key", "left_semi").select(F.lit("loaded").alias("state"), F.col("new_key").alias("key"))
    missing = known.join(new, "new_key", "left_anti").select(F.lit("missing").alias("state"), F.col("new_key").alias("key"))
    unexpected = new.join(known, "new_key", "left_anti").select(F.lit("unexpected").alias("state"), "key")
    from pyspark.sql import Window as W

    rows = loaded.unionByName(missing).unionByName(unexpected).withColumn("r", F.row_number().over(W.partitionBy("state").orderBy("key")))
    return rows.groupBy("state").agg(F.count("*").alias("keys"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= examples, F.col("key")))), ", ").alias("examples"))


def weight_files(index: DataFrame) -> DataFrame:
    """(folder, file): the different files of sharded weights; input (folder, weight_map)."""
    return index.select("folder", F.explode(F.array_distinct(F.map_values("weight_map"))).alias("file"))


def adapter_checkpoints(folders: DataFrame) -> DataFrame:
    """Adds ``adapter``: whether a folder holds an adapter-tuned model; input (folder, log, keys), both nullable.

    The method that the log names decides, else that of the path, else whether a tensor key is an adapter's.
    """
    told = F.nullif(F.regexp_extract("log", r"(?m)^\s*active_method:\s*(\S+)\s*$", 1), F.lit(""))
    parts = F.reverse(F.split("folder", "/"))
    by_path = F.get(F.filter(F.transform(parts, lambda x: N.method_in(x)), lambda m: m.isNotNull()), F.lit(0))
    by_keys = F.exists(F.coalesce("keys", F.array().cast("array<string>")), lambda k: F.contains(k, F.lit(".adapter.")))
    method = F.coalesce(N.method_in(told), by_path)
    return folders.withColumn("adapter", F.when(method.isNotNull(), method == "AdapterFinetuning").otherwise(by_keys))


def linear_attention(configs: DataFrame) -> DataFrame:
    """Adds ``linear``: whether a model's configuration, or its text part, lists linear-attention layers; input holds ``config`` as JSON text."""
    layers = lambda at: F.from_json(F.get_json_object("config", at), "array<string>")
    has = F.lit(False)
    for at in ("$.layer_types", "$.text_config.layer_types"):
        has = has | F.coalesce(F.array_contains(layers(at), "linear_attention"), F.lit(False))
    return configs.withColumn("linear", has)


def incompatible(configs: DataFrame) -> DataFrame:
    """Rows whose method can't train their model: prefix tuning with linear attention; input (method, config)."""
    return linear_attention(configs).where((N.method(F.col("method")) == "PrefixFT") & F.col("linear"))


def run_counters(plan: DataFrame) -> DataFrame:
    """(converted, skipped) of a rename plan; a run whose name stays is skipped."""
    return plan.agg(F.count_if(F.col("old") != F.col("new")).alias("converted"), F.count_if(F.col("old") == F.col("new")).alias("skipped"))


def layer_groups(modules: DataFrame, targets: list[str]) -> DataFrame:
    """(layer, layer_no, modules): matched modules by layer, layers and modules in first-seen order; input (pos, path)."""
    hit = modules.where(N.matches_module(F.col("path"), targets)).select("pos", "path", N.layer_name(F.col("path")).alias("layer"))
    g = hit.groupBy("layer").agg(F.min("pos").alias("__p"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("modules"))
    return g.select("layer", F.row_number().over(W.partitionBy().orderBy("__p")).alias("layer_no"), "modules")  # a model's layers


def chosen_layers(groups: DataFrame, side: str, count: int) -> DataFrame:
    """The first or last ``count`` layer groups, or all; an error where there are fewer."""
    if side == "full":
        return groups
    total = groups.count()
    if count > total:
        raise ValueError(f"{count} layers wanted, {total} there")
    return groups.where(F.col("layer_no") <= count) if side == "top" else groups.where(F.col("layer_no") > total - count)


def trainable(params: DataFrame) -> DataFrame:
    return params.agg(F.coalesce(F.sum(F.when(F.col("requires_grad"), F.col("n"))), F.lit(0)).cast("long").alias("trainable"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))


def best_checkpoint(metrics: DataFrame, by: str) -> DataFrame:
    """(by, step, loss): the finite lowest loss of each run, the first on ties."""
    ok = metrics.where(F.col("loss").isNotNull() & ~F.isnan("loss") & (F.abs("loss") < float("inf")))
    return ok.groupBy(by).agg(F.min(F.struct("loss", "step")).alias("x")).select(by, "x.step", "x.loss")


def running_best(metrics: DataFrame, by: str) -> DataFrame:
    """Adds ``best_before`` and ``improved`` along each run's steps."""
    w = W.partitionBy(by).orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    best = F.min("loss").over(w)
    return metrics.withColumns({"best_before": best, "improved": F.coalesce(F.col("loss") < best, F.lit(True))})


def first_per_epoch(metrics: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy("step"))).where("__r = 1").drop("__r")


def latest(files: DataFrame, by: str) -> DataFrame:
    """(by, path): the folder with the highest number in its name, then the newest, then the last by path."""
    no = F.regexp_extract("path", r"(\d+)(?!.*\d)", 1)
    rank = F.struct((no != "").alias("a"), F.try_to_number(F.nullif(no, F.lit("")), F.lit("999999999999")).cast("long").alias("b"), F.col("modified").alias("c"), F.col("path").alias("d"))
    return files.groupBy(by).agg(F.max_by("path", rank).alias("path"))


def retained(steps: DataFrame, by: str, last: int) -> DataFrame:
    return steps.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("step")))).where(F.col("__r") <= last).drop("__r")


def rename_plan(dirs: DataFrame) -> DataFrame:
    """(old, new): target names made unique by a ``__dupN`` ending, in order of the old names; input (old, target)."""
    r = F.row_number().over(W.partitionBy("target").orderBy("old"))
    return dirs.withColumn("__r", r).select("old", F.when(F.col("__r") == 1, F.col("target")).otherwise(F.concat("target", F.lit("__dup"), (F.col("__r") - 1).cast("string"))).alias("new"))


def sweep(spark, grid: dict[str, list]) -> DataFrame:
    """Every combination of a few settings, with its command line."""
    out = spark.range(1).select()
    for name, values in grid.items():
        one = spark.createDataFrame([(str(v),) for v in values], f"`{name}` string")
        out = one if not out.columns else out.crossJoin(one)
    return out.withColumn("command", F.concat_ws(" ", *[F.concat(F.lit(f"--{n}="), F.col(f"`{n}`")) for n in grid]))
