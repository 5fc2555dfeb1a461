"""Command line: ``python -m undula <job> ...`` (or spark-submit). Options override the JSON config."""

from __future__ import annotations

import argparse
import json

from undula.operators.tagging import TagRules
from undula.plans import folders, jobs
from undula.session import build_session
from undula.sources import store


def floats(v: str) -> tuple[float, ...]:
    return tuple(float(x) for x in v.split(","))


def options(p: argparse.ArgumentParser, defaults: object) -> None:
    """One option per field of a settings object; absent options keep lower layers."""
    for name, value in vars(defaults).items():
        flag = f"--{name.replace('_', '-')}"
        if isinstance(value, bool):
            p.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
        elif isinstance(value, tuple):
            p.add_argument(flag, type=floats, default=None)
        else:
            p.add_argument(flag, type=type(value) if value is not None else int, default=None)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="undula")
    sub = top.add_subparsers(dest="job", required=True)

    def job(name: str, *paths: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("--config", help="JSON file with settings")
        p.add_argument("--refresh", action="store_true", help="rebuild even when a current result exists")
        for path in paths:
            p.add_argument(f"--{path}", required=True)
        return p

    p = job("tag", "data", "labels", "out")
    p.add_argument("--acc", default=None)
    options(p, jobs.TagWindows())
    options(p, TagRules())
    p = job("recording-events", "data", "tags", "out")
    p.add_argument("--acc", default=None)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--split", type=floats, default=(0.8, 0.1, 0.1))
    options(p, jobs.EventSettings())
    for name in ("prepare-windows", "window-events"):
        options(job(name, "root", "out"), folders.WindowEvents())
    p = job("search", "data", "out")
    p.add_argument("--dataset", choices=sorted(folders.SEARCH_DEFAULTS), required=True)
    p.add_argument("--ups", type=float, required=True)
    p.add_argument("--dead-zone", type=float, required=True)
    p.add_argument("--theta0", type=floats)
    p.add_argument("--theta-max", type=floats)
    p.add_argument("--out-len", type=int)
    for name in ("method", "init", "fall-policy", "acc", "case"):
        p.add_argument(f"--{name}")
    for name in ("stride", "target-domain", "seed"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--split", type=floats)
    p.add_argument("--val-ratio", type=float)
    p.add_argument("--final-test-all", action=argparse.BooleanOptionalAction, default=None)
    for name in ("init_step", "min_step", "step_shrink", "improve_tol", "alpha", "theta_min", "max_pct", "max_scale", "max_floor", "max_margin"):
        p.add_argument(f"--{name.replace('_', '-')}", type=float)
    for name in ("max_epochs", "patience_global", "patience_step", "decimals", "train_per_class", "val_per_class", "test_per_class"):
        p.add_argument(f"--{name.replace('_', '-')}", type=int)
    p = job("energy", "runs", "calls", "out")
    p.add_argument("--name")
    p.add_argument("--prefix", default="energy")
    p.add_argument("--data-movement", action=argparse.BooleanOptionalAction, default=True)
    return top


def main(argv: list[str] | None = None, spark=None) -> object:
    a = parser().parse_args(argv)
    spark = spark or build_session(f"undula-{a.job}")
    config = json.loads("\n".join(r[0] for r in spark.read.text(a.config).collect())) if a.config else {}
    given = {k: v for k, v in vars(a).items() if v is not None}
    settings = lambda d, section: folders.resolve(d, config, section, given)
    if a.job == "tag":
        result = folders.tag_folder(
            spark, a.data, a.labels, a.out, settings(jobs.TagWindows(), "posture_tagging"), settings(TagRules(), "posture_tagging"),
            a.acc or config.get("acc", "ADXL345"), a.refresh,
        )
    elif a.job == "recording-events":
        events = settings(jobs.EventSettings(), "events")
        result = folders.recording_events_folder(spark, a.data, a.tags, a.out, events, a.split, a.seed, a.acc or config.get("acc", "ADXL345"), a.refresh)
    elif a.job in ("prepare-windows", "window-events"):
        run = folders.prepare_windows_folder if a.job == "prepare-windows" else folders.window_events_folder
        result = run(spark, a.root, a.out, settings(folders.WindowEvents(), "windows"), a.refresh)
    elif a.job == "search":
        known = {*folders.SEARCH_SHARED, *folders.SEARCH_DEFAULTS[a.dataset], "step_shrink", "improve_tol"} - {"theta0", "in_len"}
        over = {k: v for k, v in {**config, **given}.items() if k in known}
        job = settings(folders.SearchJob(a.dataset, a.ups, a.dead_zone, overrides=over), "search")
        result = folders.search_folder(spark, a.data, a.out, job, a.refresh)
    else:
        result = folders.energy_folder(spark, a.runs, a.calls, a.out, a.name, a.data_movement, a.prefix)
    if isinstance(result, dict):
        print(json.dumps(store.plain(result), indent=2))
    elif a.job != "energy":
        folders.split_summary(result).show(truncate=False)
    else:
        result.show(truncate=False)
    return result


if __name__ == "__main__":
    main()
