"""python -m tideglass STAGE [--config FILE]"""

from __future__ import annotations

import argparse
import json

from .plans.config import as_dict, load
from .plans.research import STAGES, Research
from .session import session
from .sources.store import plain


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tideglass")
    p.add_argument("stage", choices=["info", *STAGES, "reproduce", "lockbox", "lint"])
    p.add_argument("--config")
    p.add_argument("--work-dir")
    p.add_argument("--only", help="one model to train")
    p.add_argument("--force", action="store_true")
    p.add_argument("--reason", default="")
    a = p.parse_args(argv)
    cfg = load(a.config, **({"work_dir": a.work_dir} if a.work_dir else {}))
    if a.stage == "info":
        print(json.dumps(plain(as_dict(cfg)), indent=1))
        return 0
    spark = session()
    if a.stage == "lint":
        from .plans.lint import lint_features

        found = lint_features(spark)
        print(json.dumps(found, indent=1))
        return int(bool(found))
    how = {"only": a.only} if a.stage == "train" and a.only else {"force": a.force, "reason": a.reason} if a.stage == "lockbox" else {}
    Research(spark, cfg).run(a.stage, **how)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
