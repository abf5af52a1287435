"""Run, module and tensor names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings of the four attention projections.
MODULE_ALIASES = {"q": ["q_proj", "query_proj", "query", "q"], "k": ["k_proj", "key_proj", "key", "k"], "v": ["v_proj", "value_proj", "value", "v"], "o": ["o_proj", "out_proj", "output_proj", "output", "o"]}
# Names of containers whose numbered children are layers.
CONTAINERS = "layers|blocks|h|layer|block"


def model_size(name: Column) -> Column:
    """``2B``, ``0.8B`` and the like with nothing alphanumeric around, the B in upper case; null where there is none."""
    found = F.regexp_extract(name, r"(?<![A-Za-z0-9.])(\d+(?:\.\d+)?[Bb])(?![A-Za-z0-9])", 1)
    return F.when(found != "", F.upper(found))


def number(c: Column) -> Column:
    """Whole numbers without a point, others with up to six significant digits, in powers of ten below 1e-4 and from 1e6 on.

    A number whose shortest form ends in a 5 in the seventh place is rounded up.
    """
    x = c.cast("double")
    shown = F.format_string("%.5e", F.abs(x))
    digits = F.rtrim(F.regexp_replace(F.substring_index(shown, "e", 1), r"\.", ""), F.lit("0"))
    power = F.substring_index(shown, "e", -1).cast("int")
    point = lambda whole, rest: F.concat(whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    # digits up to the point are never cut away: zeros come back where the number ends before it
    middle = point(F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.substring(digits, power + 2, F.lit(9)))
    science = F.concat(point(F.substring(digits, 1, 1), F.substring(digits, 2, 9)), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    plain = F.when((power < -4) | (power >= 6), science).when(power < 0, small).otherwise(middle)
    return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), plain))


def safe_part(c: Column, fallback: str, joint: str = "-") -> Column:
    """A name without blanks, slashes, colons and (joined by ``-``) equals signs; ``joint="_"`` is the variant of folder names."""
    marks, ends = (r"[\\/:\s=]+", "^[-_]+|[-_]+$") if joint == "-" else (r"[\\/:\s]+", "^_+|_+$")
    cleaned = F.regexp_replace(F.regexp_replace(F.trim(c), marks, joint), ends, "")
    return F.when(cleaned == "", F.lit(fallback)).otherwise(cleaned)


def scaling_type(c: Column) -> Column:
    s = F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("/"))
    return F.when(s == "", F.lit("r/a")).otherwise(F.coalesce(s, F.lit("r/a")))


def timestamp10(c: Column) -> Column:
    """Ten digits of month to second; fourteen lose the year; anything else is null."""
    d = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(d) == 10, d).when(F.length(d) == 14, F.substring(d, 5, 10))


def timestamp_prefix(c: Column) -> Column:
    """The timestamp a directory name starts with, as ten digits, or null."""
    long = r"^\d{4}(\d{2})(\d{2})[_-]?(\d{2})(\d{2})(\d{2})(?:[_-]|$)"
    short = r"^(\d{10})(?:[_-]|$)"
    joined = F.concat(*[F.regexp_extract(c, long, i) for i in range(1, 6)])
    return F.when(joined != "", joined).otherwise(F.nullif(F.regexp_extract(c, short, 1), F.lit("")))


def after_timestamp(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?:\d{8}[_-]?\d{6}|\d{10})(?:[_-]+|$)", "")


def layer_selection(side: Column, count: Column) -> Column:
    """``full``, ``top-N`` or ``end-N``; null for an unknown side or a count under 1."""
    s = F.lower(F.trim(F.coalesce(side, F.lit("all"))))
    front = F.when(s.isin("front", "first", "input", "top"), "top").when(s.isin("back", "last", "output", "end"), "end")
    return F.when(s.isin("", "all", "none", "full"), "full").when(front.isNotNull() & (count > 0), F.concat(front, F.lit("-"), count.cast("string")))


def module_code(modules: Column) -> Column:
    """``qkvo`` letters of the projections present, else the distinct base names joined by ``-``."""
    base = F.transform(modules, lambda m: F.lower(F.trim(F.substring_index(m, ".", -1))))
    letters = F.concat(*[F.when(F.arrays_overlap(base, F.array(*[F.lit(a) for a in names])), F.lit(k)).otherwise(F.lit("")) for k, names in MODULE_ALIASES.items()])
    plain = F.array_join(F.array_distinct(F.transform(modules, lambda m: safe_part(F.substring_index(m, ".", -1), "module"))), "-")
    return F.when(letters != "", letters).otherwise(plain)


def core_name(size: Column, rank: Column, scaling: Column, dropout: Column, layers: Column, modules: Column) -> Column:
    s = scaling_type(scaling)
    return F.concat_ws("_", size, F.concat(F.lit("R-"), number(rank)), F.when(s != "r/a", F.concat(F.lit("AL-"), safe_part(s, "scaling"))), F.when(dropout != 0, F.concat(F.lit("DR-"), number(dropout))), layers, modules)


def parsed_run(c: Column) -> Column:
    """A run directory name taken apart: timestamp, size, rank, scaling, dropout, layers, modules, run name."""
    rest = after_timestamp(c)
    get = lambda p: F.nullif(F.regexp_extract(rest, p, 1), F.lit(""))
    return F.struct(
        timestamp_prefix(c).alias("timestamp"),
        model_size(F.replace(rest, F.lit("_"), F.lit(" "))).alias("size"),
        get(r"(?:^|_)R-(\d+)").cast("int").alias("rank"),
        get(r"(?:^|_)AL-([^_]+)").alias("scaling"),
        get(r"(?:^|_)DR-([0-9.]+)").cast("double").alias("dropout"),
        get(r"(?:^|_)(full|top-\d+|end-\d+)(?:_|$)").alias("layers"),
        get(r"(?:full|top-\d+|end-\d+)_([^_]+)").alias("modules"),
        get(r"(?:full|top-\d+|end-\d+)_[^_]+_(.+)$").alias("run_name"),
    )


def layer_name(path: Column) -> Column:
    """The dotted path up to the first number below a layer container, else up to the first number, else the parent."""
    known = F.regexp_extract(path, rf"^((?:[^.]+\.)*?(?:{CONTAINERS}|[^.]*layers|[^.]*blocks)\.\d+)(?:\.|$)", 1)
    first = F.regexp_extract(path, r"^((?:[^.]*[^.0-9][^.]*\.)*\d+)(?:\.|$)", 1)
    parent = F.when(F.contains(path, F.lit(".")), F.regexp_replace(path, r"\.[^.]*$", "")).otherwise(path)
    return F.coalesce(F.nullif(known, F.lit("")), F.nullif(first, F.lit("")), parent)


def matches_module(path: Column, targets: list[str]) -> Column:
    """Equal to a target or ending in one after a dot."""
    hits = [(path == t) | F.endswith(path, F.lit("." + t)) for t in targets]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def named_layers(c: Column) -> Column:
    """The layer selection a directory name tells: (side, count, code), or null."""
    low = F.lower(c)
    found = [F.struct(F.nullif(F.regexp_extract(low, p, 1), F.lit("")).alias("w"), F.regexp_extract(low, p, 2).alias("n")) for p in (r"(?:^|[_-])(top)[-_]?(\d+)(?:$|[_-])", r"(?:^|[_-])(end)[-_]?(\d+)(?:$|[_-])", r"layers[=_-](input|front|first|top)[-_]?(\d+)(?:$|[_-])", r"layers[=_-](output|back|last|end)[-_]?(\d+)(?:$|[_-])")]
    first = F.coalesce(*[F.when(x["w"].isNotNull(), x) for x in found])
    top = first["w"].isin("top", "input", "front", "first")
    picked = F.struct(F.when(top, "input").otherwise("output").alias("side"), first["n"].cast("int").alias("count"), F.concat(F.when(top, "top-").otherwise("end-"), first["n"].cast("int").cast("string")).alias("code"))
    full = F.struct(F.lit("all").alias("side"), F.lit(0).alias("count"), F.lit("full").alias("code"))
    return F.when(F.regexp_like(low, F.lit(r"(?:^|[_-])full(?:$|[_-])")), full).when(first.isNotNull() & (first["n"].cast("int") > 0), picked)


def side(c: Column) -> Column:
    """all, input or output, whatever the spelling; blank is null, other words stay as they are in lower case."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("all", "none", "full"), "all").when(s.isin("input", "front", "first", "top"), "input").when(s.isin("output", "back", "last", "end"), "output").otherwise(F.nullif(s, F.lit("")))


# The module each letter of a module code stands for.
MODULE_OF = {"q": "q_proj", "k": "k_proj", "v": "v_proj", "o": "o_proj"}


def filled_from_name(c: Column, config: dict[str, Column]) -> Column:
    """A run's settings, those that are missing read from its directory name: model, rank, scaling, dropout, modules, side, count."""
    get = lambda p, text=c: F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit(""))
    blank = lambda k: F.nullif(config[k].cast("string"), F.lit(""))
    rank = F.coalesce(get(r"(?:^|[_-])R[-_=]?(\d+)(?:$|[_-])"), get(r"(?:^|[_-])(?:lora_)?r(?:ank)?[=-](\d+)(?:$|[_-])")).cast("int")
    scaling = F.regexp_replace(get(r"scaling[=-](r[/_-]a|r[/_-]sqrta)"), "[_-]", "/")
    dropout = get(r"dropout(?:_rate)?[=-]([0-9.eE+-]+)(?:$|[_-])").try_cast("double")
    code = get(r"(?:^|_)([qkvo]{1,4})(?:$|_)", F.lower(c))
    modules = F.array_compact(F.array(*[F.when(F.contains(code, F.lit(k)), F.lit(m)) for k, m in MODULE_OF.items()]))
    told = named_layers(c)
    own, count = side(config["side"]), config["count"].cast("int")
    known = (own == "all") | (own.isin("input", "output") & count.isNotNull())
    return F.struct(
        F.coalesce(blank("model"), model_size(F.regexp_replace(c, "_", " "))).alias("model"),
        F.coalesce(F.nullif(config["rank"].cast("int"), F.lit(0)), rank).alias("rank"),
        F.coalesce(blank("scaling"), scaling).alias("scaling"),
        F.coalesce(F.nullif(config["dropout"].cast("double"), F.lit(0.0)), dropout).alias("dropout"),
        F.when(F.size(F.coalesce(config["modules"], F.array().cast("array<string>"))) > 0, config["modules"]).when(code.isNotNull(), modules).alias("modules"),
        F.when(known, own).when(told.isNotNull(), told["side"]).otherwise(F.lit("all")).alias("side"),
        F.when(own == "all", 0).when(known, count).when(told.isNotNull(), told["count"]).otherwise(0).alias("count"),
    )


def run_name(c: Column, core: Column, logged: Column | None = None) -> Column:
    """The name a run was given: the logged one, else what stands behind timestamp and core name, or behind ``lora_``; null for none."""
    rest = after_timestamp(c)
    behind = lambda head: F.nullif(F.substring(rest, F.length(head) + 1, F.length(rest)), F.lit(""))
    told = F.when(rest == core, F.lit(None)).when(F.startswith(rest, F.concat(core, F.lit("_"))), behind(F.concat(core, F.lit("_")))).when(F.startswith(F.lower(rest), F.lit("lora_")), behind(F.lit("lora_")))
    return told if logged is None else F.coalesce(logged, told)


def directory_name(timestamp: Column, core: Column, name: Column) -> Column:
    return F.concat_ws("_", timestamp10(timestamp), core, F.when(F.trim(name) != "", safe_part(name, "run")))


def run_timestamp(c: Column, modified: Column) -> Column:
    """The timestamp a directory name starts with, else the folder's time of change as ten digits."""
    return F.coalesce(timestamp_prefix(c), F.date_format(modified, "MMddHHmmss"))


def is_lora_run(name: Column, log: Column | None = None) -> Column:
    """A directory name that says so, or holds a model size and a rank, or whose log names the method."""
    sized = F.regexp_replace(name, "_", " ")
    said = F.contains(F.lower(name), F.lit("lora")) | (model_size(sized).isNotNull() & F.regexp_like(name, F.lit(r"(?:^|_)R-\d+")))
    return said if log is None else said | F.coalesce(F.contains(F.lower(log), F.lit("active_method: lora")), F.lit(False))


# Spellings of the three training methods.
METHODS = {"lora": "LoRA", "prefixft": "PrefixFT", "prefix": "PrefixFT", "prefix_tuning": "PrefixFT", "prefixtuning": "PrefixFT", "adapter": "AdapterFinetuning", "adapterft": "AdapterFinetuning", "adapter_finetuning": "AdapterFinetuning", "adapterfinetuning": "AdapterFinetuning", "adaption_prompt": "AdapterFinetuning", "adaptionprompt": "AdapterFinetuning", "llama_adapter": "AdapterFinetuning"}


def method(c: Column) -> Column:
    """The training method a setting names exactly, in any spelling; null for another word."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv]), F.lower(F.trim(c)))


def method_in(c: Column) -> Column:
    """The training method a path or log value mentions, or null."""
    s = F.lower(c)
    return F.when(s.contains("adapterfinetuning") | s.contains("adapter_finetuning"), "AdapterFinetuning").when(s.contains("prefix"), "PrefixFT").when(s.contains("lora"), "LoRA")


def matches_adapter(path: Column, target: str) -> Column:
    """The adapter's own rule: a path that ends in the target, whatever stands before."""
    return F.endswith(path, F.lit(target))


# Prefixes that checkpoints carry or lack, in order, and those that stand for another.
PREFIXES = ["module.", "_orig_mod.", "base_model.model.", "model."]
REPLACED = [("model.language_model.", "model."), ("language_model.", "model.")]
# The attention block, and the two ways in which an adapter wraps it.
BLOCK, WRAPPED, ADAPTED = ".self_attn.", ".self_attn.module.", ".self_attn.adapter."


def prefix_changes(key: Column) -> list[tuple[str, Column]]:
    """Eleven ways to change a tensor key's beginning, in order; keys without the prefix stay as they are."""
    cut = lambda p, new="": F.when(F.startswith(key, F.lit(p)), F.concat(F.lit(new), F.substring(key, F.lit(len(p) + 1), F.length(key)))).otherwise(key)
    ways = [("identity", key)]
    for p in PREFIXES:
        ways += [(f"strip '{p}'", cut(p)), (f"add '{p}'", F.concat(F.lit(p), key))]
    return ways + [(f"replace '{old}' with '{new}'", cut(old, new)) for old, new in REPLACED]


def wrapped(key: Column) -> Column:
    """The key with the adapter's wrapper in its first attention block, unless it is wrapped or an adapter's own."""
    fits = F.contains(key, F.lit(BLOCK)) & ~F.contains(key, F.lit(WRAPPED)) & ~F.contains(key, F.lit(ADAPTED))
    return F.when(fits, F.regexp_replace(key, r"^(.*?)\.self_attn\.", r"$1.self_attn.module.")).otherwise(key)


def unwrapped(key: Column) -> Column:
    return F.regexp_replace(key, r"^(.*?)\.self_attn\.module\.", r"$1.self_attn.")
