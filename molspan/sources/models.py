"""Model files, tables of chances and counts, profiles, and what a training run leaves."""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molspan.functions.chain import Model
from molspan.functions.encoding import alphabet, iter_contexts, n_symbols
from molspan.functions.marks import ALIASES
from molspan.operators.recall import Profile

# The enzymes, what they are sequenced with, and the mode of each.
MODES = {("hia5", "pacbio"): "pacbio-fiber", ("hia5", "nanopore"): "nanopore-fiber", ("dddb", None): "daf", ("ddda", None): "daf"}
WITH_PLATFORM, PLATFORM = ("hia5",), "pacbio"


@dataclass(frozen=True)
class Saved:
    """A model with what its file says about it."""

    model: Model
    k: int = 3
    mode: str = "unknown"


# Files


def text_of(spark: SparkSession | None, path: str) -> str:
    """A small text file, through Spark if there is a session, so from any store."""
    if spark is None:
        with open(path, encoding="utf-8") as file:
            return file.read()
    return spark.read.text(path, wholetext=True).first()[0]


def from_parts(start: object, trans: object, emission: object, *, ordered: bool = True) -> Model:
    """A model from its arrays; emission as (states, symbols), or (symbols, states)."""
    start, trans, emission = (np.asarray(x, float) for x in (start, trans, emission))
    if emission.ndim == 2 and emission.shape[0] != 2 and emission.shape[1] == 2:
        emission = emission.T
    if start.shape != (2,) or trans.shape != (2, 2) or emission.ndim != 2 or emission.shape[0] != 2:
        raise ValueError("a model has two states: start (2), transitions (2, 2) and emissions (2, symbols)")
    model = Model((float(start[0]), float(start[1])), (float(trans[0, 0]), float(trans[1, 1])), tuple(tuple(map(float, row)) for row in emission))
    return model.ordered() if ordered else model


def from_dict(data: Mapping, *, ordered: bool = True) -> Saved:
    """A model from any of the layouts of a file: startprob or startprob_, and so on; also one under ``model``."""
    inner = data.get("model", data)
    if not isinstance(inner, Mapping):
        raise ValueError("no model in it")
    get = lambda name: inner.get(name, inner.get(f"{name}_"))
    if any(get(n) is None for n in ("startprob", "transmat", "emissionprob")):
        raise ValueError("startprob, transmat and emissionprob are needed")
    mode = str(data.get("mode", inner.get("mode", "unknown")))
    return Saved(from_parts(get("startprob"), get("transmat"), get("emissionprob"), ordered=ordered), int(data.get("context_size", inner.get("context_size", 3))), ALIASES.get(mode, mode))


def load(path: str, *, spark: SparkSession | None = None, ordered: bool = True) -> Saved:
    """A model file: .json, or .npz arrays. ordered: state 0 is the one with fewer hits.

    Pickled files are refused, as reading them runs code; convert them where they come from.
    """
    if path.endswith(".npz"):
        with np.load(path, allow_pickle=False) as found:
            return from_dict({k: found[k].item() if found[k].ndim == 0 else found[k] for k in found.files}, ordered=ordered)
    if not path.endswith(".json"):
        raise ValueError(f"{path}: only .json and .npz models are read")
    return from_dict(json.loads(text_of(spark, path)), ordered=ordered)


def foreign(other: object) -> Model:
    """A model from any object with the attributes startprob_, transmat_ and emissionprob_ (or emissionprob)."""
    emission = getattr(other, "emissionprob_", getattr(other, "emissionprob", None))
    start, trans = getattr(other, "startprob_", None), getattr(other, "transmat_", None)
    if start is None or trans is None or emission is None:
        raise ValueError(f"{type(other).__name__} lacks startprob_, transmat_ or emissionprob_")
    return from_parts(start, trans, emission)


def to_dict(saved: Saved, *, by_symbol: bool = False) -> dict[str, object]:
    """by_symbol: only the arrays, emissions as one pair a symbol."""
    m = saved.model
    trans = [[m.stay[0], 1 - m.stay[0]], [1 - m.stay[1], m.stay[1]]]
    if by_symbol:
        return {"startprob": list(m.start), "transmat": trans, "emissionprob": [list(x) for x in zip(*m.emission)]}
    return {"model_type": "two-state chain", "version": "2.0", "n_states": 2, "startprob": list(m.start), "transmat": trans, "emissionprob": [list(x) for x in m.emission], "context_size": saved.k, "mode": saved.mode}


def save(saved: Saved, path: str, *, by_symbol: bool = False) -> str:
    """Writes a model as JSON and returns the path, whose ending becomes .json if it is another."""
    if not path.endswith(".json"):
        path, given = os.path.splitext(path)[0] + ".json", path
        warnings.warn(f"models are written as JSON: {path} instead of {given}", stacklevel=2)
    with open(path, "w", encoding="utf-8") as file:
        json.dump(to_dict(saved, by_symbol=by_symbol), file, indent=2)
    return path


def entry(enzyme: str, platform: str | None = None, *, warn: bool = True) -> tuple[str, str | None]:
    """The registry's key for an enzyme; one that needs a platform gets the default, with a warning."""
    enzyme = enzyme.lower()
    key = None
    if enzyme in WITH_PLATFORM:
        if platform is None and warn:
            warnings.warn(f"no platform for {enzyme}: taking {PLATFORM}", stacklevel=3)
        key = (platform or PLATFORM).lower()
    if (enzyme, key) not in MODES:
        raise KeyError(f"no model for {enzyme!r} on {platform!r}; there are {sorted(f'{e}/{p or chr(42)}' for e, p in MODES)}")
    return enzyme, key


def mode_of(enzyme: str, platform: str | None = None) -> str:
    return MODES[entry(enzyme, platform, warn=False)]


def registered(folder: str, enzyme: str, tool: str = "recall", platform: str | None = None) -> str:
    """The path of an enzyme's model in a folder: enzyme[_platform][_tool].json, the most exact name that is there."""
    if tool not in ("apply", "recall"):
        raise KeyError(f"{tool!r} is neither apply nor recall")
    name = "_".join(x for x in entry(enzyme, platform) if x)
    for path in (os.path.join(folder, f"{name}_{tool}.json"), os.path.join(folder, f"{name}.json")):
        if os.path.isfile(path):
            return path
    raise FileNotFoundError(f"{folder} has neither {name}_{tool}.json nor {name}.json")


def resolve_mode(explicit: str | None, inferred: str | None, told: str | None) -> str:
    """The mode that is asked for, else the one that the data show, else the model's; ValueError without any."""
    for mode in (explicit, inferred, told):
        if mode and mode != "unknown":
            return ALIASES.get(mode, mode)
    raise ValueError("the mode is neither given nor told by the data or the model")


def profile(path: str, *, spark: SparkSession | None = None) -> Profile:
    """A radial profile: JSON with radial, linker, and if they differ half, min_sep and edge_frac."""
    data = json.loads(text_of(spark, path))
    names = {"half": "half", "min_sep": "apart", "edge_frac": "edge"}
    return Profile(tuple(float("nan") if x is None else float(x) for x in data["radial"]), float(data["linker"]), **{mine: type(getattr(Profile, mine))(data[theirs]) for theirs, mine in names.items() if theirs in data})


# Looking at models, and changing them


def inspect(saved: Saved) -> dict[str, object]:
    """What a model says: size, how long states last on average, and each state's chances of a hit."""
    top = len(saved.model.emission[0]) // 2
    states = []
    for s in (0, 1):
        p = np.array(saved.model.emission[s][: max(top - 1, 1)])
        states.append({"state": s, "start": saved.model.start[s], "stay": saved.model.stay[s], "duration": 1 / max(1 - saved.model.stay[s], 1e-300), "least": float(p.min()), "greatest": float(p.max()), "mean": float(p.mean()), "std": float(p.std())})
    return {"k": saved.k, "mode": saved.mode, "symbols": len(saved.model.emission[0]), "states": states}


def adjusted(saved: Saved, state: int, factor: float) -> Saved:
    """The chances of a hit of one state times a factor, kept within 0 and 1; those of a miss are the rest."""
    rows, top = [np.array(x) for x in saved.model.emission], alphabet(saved.k)
    row = rows[state]
    row[:top] = np.clip(row[:top] * factor, 0.0, 1.0)
    row[top + 1 : 2 * top + 1] = 1 - row[:top]
    return replace(saved, model=replace(saved.model, emission=tuple(tuple(map(float, r)) for r in rows)))


def emissions(table: Mapping[str, tuple[float, float]], k: int, centre: str, *, adjust: float = 1.0) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Emissions of (protected, accessible) from {context: (p_acc, p_prot)}; a context that isn't there has no hits.

    Contexts are found by their text, so tables may number them as they like.
    """
    top, out = alphabet(k), np.zeros((2, n_symbols(k)))
    for code, context in iter_contexts(k, centre):
        p_acc, p_prot = table.get(context, (0.0, 0.0))
        for s, p in ((0, p_prot), (1, p_acc)):
            p = min(max(p * adjust, 0.0), 1.0)
            out[s, code], out[s, code + top + 1] = p, 1 - p
    out[:, top] = 1e-30
    out[:, -1] = 1.0
    return tuple(map(float, out[0])), tuple(map(float, out[1]))


def emission_rows(spark: SparkSession, saved: Saved) -> DataFrame:
    """(code, p0, p1): a model's emissions as a table."""
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(*saved.model.emission))], "code int, p0 double, p1 double")


# Tables


def tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def first_of(df: DataFrame, *names: str) -> Column | None:
    """The first column of one of the names, whatever their case."""
    by = {c.lower(): c for c in df.columns}
    return next((F.col(by[n]) for n in names if n in by), None)


def probabilities(spark: SparkSession, path: str) -> DataFrame:
    """(context, hit, nohit, ratio) of a table of chances with a header, however its columns are called.

    Without a ratio it is hit / (hit + nohit); a table of ratios alone has null counts.
    """
    df = tsv(spark, path)
    context, hit, nohit, ratio = (first_of(df, *names) for names in (("context", "kmer", "hexamer"), ("hit", "hits", "methylated"), ("nohit", "no_hit", "misses", "unmethylated"), ("ratio", "prob", "probability", "p")))
    if context is None or ratio is None and (hit is None or nohit is None):
        raise ValueError(f"{path}: a context and a ratio, or hit and nohit, are needed; there are {df.columns}")
    none = F.lit(None).cast("double")
    hit, nohit = (none if c is None else c.cast("double") for c in (hit, nohit))
    ratio = none if ratio is None else ratio.cast("double")
    return df.select(F.upper(context).alias("context"), hit.alias("hit"), nohit.alias("nohit"), F.coalesce(ratio, hit / F.nullif(hit + nohit, F.lit(0.0)), F.lit(0.0)).alias("ratio"))


def priors(spark: SparkSession, path: str) -> DataFrame:
    """(context, accessible_bp, total_bp, p_accessible) of a table with a header."""
    return tsv(spark, path).select(F.upper("context").alias("context"), F.col("accessible_bp").cast("long"), F.col("total_bp").cast("long"), F.coalesce(F.expr("try_cast(p_accessible AS double)"), F.lit(0.5)).alias("p_accessible"))


def training_ids(spark: SparkSession, path: str) -> DataFrame:
    """(read_id) of a list with a column rid, each once."""
    return tsv(spark, path).select(F.col("rid").alias("read_id")).where("read_id IS NOT NULL").distinct()


def flag_trained(reads: DataFrame, ids: DataFrame) -> DataFrame:
    """reads plus ``trained``: whether the molecule is in ids (read_id, distinct). No row goes."""
    return reads.join(ids.withColumn("trained", F.lit(True)), "read_id", "left").withColumn("trained", F.coalesce("trained", F.lit(False)))


def write_table(df: DataFrame, path: str) -> None:
    """One tab-separated table with a header, in the order of its first column; for tables of contexts and the like."""
    df.coalesce(1).sortWithinPartitions(df.columns[0]).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_probabilities(counts: DataFrame, path: str) -> None:
    """A table of chances: encode, context, hit, nohit, ratio of rows (context, hit, nohit), by context."""
    from molspan.operators.contexts import dense_codes

    made = dense_codes(counts).select("encode", "context", "hit", "nohit", F.coalesce(F.col("hit") / F.nullif(F.col("hit") + F.col("nohit"), F.lit(0)), F.lit(0.0)).alias("ratio"))
    write_table(made, path)


def write_training(folder: str, best: Saved, every: list[tuple[Model, float]], config: Mapping[str, object]) -> None:
    """best-model.json, all_models.json and model_config.json of a training run, in a folder of the driver's machine."""
    os.makedirs(folder, exist_ok=True)
    save(best, os.path.join(folder, "best-model.json"))
    listed = [{**to_dict(replace(best, model=m)), "score": s} for m, s in every]
    for name, data in (("all_models.json", listed), ("model_config.json", {**config, "context_size": best.k, "mode": best.mode})):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as file:
            json.dump(data, file, indent=2)
