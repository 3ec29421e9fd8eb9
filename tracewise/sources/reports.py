"""Reports of a run: its folder, log, tables and documents. Tables here are small aggregates; the driver writes them."""

from __future__ import annotations

from datetime import datetime, timezone
from itertools import product
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.operators import aggregate as A
from tracewise.operators import collect as L
from tracewise.sources import files, loaders
from tracewise.sources.archives import opened

FOLDERS = ("configs", "data", "raw", "tables", "errors", "logs")
#: The columns of a calibration table, in their order.
CALIBRATION_COLUMNS = (
    "split", "dataset", "mode", "num_cases", "num_pairs", "weight_E_ab", "weight_E_ba", "weight_C_max", "weight_N_max", "bias", "tau", "ranking_acc", "tpr_at_tau", "positive_pass_rate", "fpr_at_tau",
    "threshold_balanced_acc", "mean_positive_score", "mean_negative_score", "mean_margin", "component", "tau_selection_metric", "target_tpr",
)
REWARD_COLUMNS = ("source", "dataset", "subcategory", "scorer", "score_field", "n_pos", "n_neg", "mean_pos", "mean_neg", "margin")
SENSITIVITY_COLUMNS = ("scorer", "score_field", "tau", "hn_fpr", "neg_fpr", "num_fpr", "ranking_acc", "hn_ranking_acc", "num_ranking_acc", "selected_operating_tau")


def now() -> str:
    """The time in UTC, to the second, as ISO text."""
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def run_stamp() -> str:
    """A name for a run by its local time."""
    return datetime.now().strftime("run_%Y%m%d_%H%M%S")


def create_layout(root: str, folders: tuple[str, ...] = FOLDERS, fresh: bool = True) -> Path:
    """The folder of a run with its parts, on a file system that pyarrow opens; with fresh, one that holds anything is an error."""
    store, name = opened(root)
    if fresh and store.get_file_info(name).type == fs.FileType.Directory and store.get_file_info(fs.FileSelector(name)):
        raise FileExistsError(f"the folder is not empty: {root}")
    for f in folders:
        store.create_dir(f"{name}/{f}", recursive=True)
    return Path(name)


def log_line(root: str, text: str, name: str = "run.log") -> None:
    """Adds a line with the time to the run's log."""
    store, folder = opened(f"{root}/logs")
    store.create_dir(folder, recursive=True)
    with store.open_append_stream(f"{folder}/{name}") as f:
        f.write(f"[{now()}] {text}\n".encode())


def write_text(path: str, text: str) -> None:
    """A small document beside the tables, on the same file system."""
    store, name = opened(path)
    with store.open_output_stream(name, compression=None) as f:
        f.write(text.encode())


def parameter_grid(**choices: list) -> list[dict]:
    """Every combination of parameters, the last one changing fastest."""
    return [dict(zip(choices, values, strict=True)) for values in product(*choices.values())]


def calibration_table(rows: DataFrame, weights: list[float], bias: float, tau: float, metric: str, target_tpr: float) -> DataFrame:
    """Metrics rows with the model, the threshold and how it was chosen."""
    given = {f"weight_{n}": F.lit(w) for n, w in zip(("E_ab", "E_ba", "C_max", "N_max"), weights, strict=True)}
    given |= {"bias": F.lit(bias), "tau": F.lit(tau), "positive_pass_rate": F.col("tpr_at_tau"), "tau_selection_metric": F.lit(metric), "target_tpr": F.lit(target_tpr)}
    return rows.withColumns(given)


def save_calibration(report: DataFrame, by_type: DataFrame, root: str) -> list[str]:
    """Four CSV tables of calibration_table rows: overall, by dataset, by subcategory and by negative type; their paths."""
    parts = {"overall": (report.where("`table` = 'overall'"), ()), "by_dataset": (report.where("`table` = 'dataset'"), ()), "by_subcategory": (report.where("`table` = 'subcategory'"), ("subcategory",)), "by_negative_type": (by_type.withColumn("negative_type", F.col("kind")), ("negative_type",))}
    paths = []
    for name, (rows, first) in parts.items():
        paths.append(f"{root}/tables/table_nli_calibration_{name}")
        files.write_csv(rows.withColumn("dataset", F.coalesce("dataset", F.lit("ALL"))).orderBy("split", "dataset", *first), paths[-1], [*first, *CALIBRATION_COLUMNS])
    return paths


def rebuild_tables(spark: SparkSession, caption: list[str], numeric: list[str], root: str, predictions: list[str] | None = None, best: str | None = None, kappa: float = 0.0) -> dict[str, str]:
    """From score files to all reward tables and the threshold table, as CSV and Markdown below root; their paths by name.

    kappa is checked first. Calibrated rows come from predictions, else from the weights in best.
    """
    from tracewise.functions.rewards import check_kappa

    check_kappa(kappa)
    create_layout(root)
    (caption_rows, caption_errors), (numeric_rows, numeric_errors) = loaders.load_scores(spark, caption), loaders.load_scores(spark, numeric)
    predicted = loaders.load_scores(spark, predictions)[0] if predictions else None
    model = loaders.load_calibration_weights(spark, best) if best else None
    rewards = L.collected(caption_rows, numeric_rows, predicted, model and model["weights"], float((model or {}).get("bias") or 0.0), kappa).cache()
    tables = {name: (t, [c for c in REWARD_COLUMNS if c in t.columns]) for name, t in L.reward_tables(rewards).items()}
    sensitivity = L.sensitivity_table(L.sensitivity_scores(caption_rows, numeric_rows, predicted), loaders.load_selected_tau(spark, best) if best else None)
    tables["tau_sensitivity"] = sensitivity.orderBy("scorer", "score_field", "tau"), list(SENSITIVITY_COLUMNS)
    out = {}
    for name, (table, columns) in tables.items():
        out[name] = f"{root}/tables/{name}"
        files.write_csv(table, out[name], columns)
        write_text(f"{out[name]}.md", files.markdown(table, columns))
    files.write_jsonl(caption_errors.unionByName(numeric_errors), f"{root}/errors/load_errors")
    log_line(root, f"{len(out)} tables")
    rewards.unpersist()
    return out


def previews(cases: DataFrame, keys: tuple[str, ...] = ("dataset", "subcategory", "mode")) -> tuple[DataFrame, DataFrame]:
    """Counts of cases and negatives by keys, and the first five cases of each."""
    return A.case_counts(cases, list(keys)).orderBy(*keys), A.preview(cases, list(keys), ["case_id"])
