"""The published learner settings, searches and folds, run as they are.

usage: python tools/reference_preset.py [sf_dir] [part ...]

Parts: the names of ``models.REFERENCE_SPECS`` (fit on the training side, metrics on the test side), ``folds`` (five
contiguous folds of the linear learners) and ``search-rf``, ``search-xrf``, ``search-gbt`` (the published ranges, draws
and five folds).  A search keeps its finished runs under $LEADTIME_SEARCH_STATE, so a stopped one goes on.  Prints
one JSON line a part: settings, seconds, rows and results.  Without parts: the learners and ``folds``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    from leadtime.session import get_session, remove_scratch
    from leadtime.plans import models as M
    from leadtime.plans.catalog_ml import training_tables
    spark = get_session(app_name="leadtime-preset")
    fm, data, tr, te, _ = training_tables(spark, sf_dir)
    rows = {"train": tr.count(), "test": te.count(), "features": len(fm.features)}
    specs = {s.name: s for s in M.REFERENCE_SPECS}
    state = os.environ.get("LEADTIME_SEARCH_STATE")
    for part in args or [*specs, "folds"]:
        t0 = time.time()
        if part in specs:
            settings = specs[part].params
            met, _, _ = M.compare_models(tr, te, fm.features, "case_id", (specs[part],))
            found = [r.asDict() for r in met.collect()]
        elif part == "folds":
            settings = {"folds": 5}
            summary, _ = M.cross_validate(data, fm.features, "case_id", M.REFERENCE_SPECS[:3], k=5)
            found = [r.asDict() for r in summary.collect()]
        else:
            kind = part.removeprefix("search-")
            space, draws = M.SPACES[kind]
            settings = {"draws": draws, "folds": 5, "space": {k: str(v) for k, v in space.items()}}
            res, _, best = M.random_search(tr, fm.features, "case_id", M.ModelSpec(kind, kind), k=5,
                                           state=f"{state}/{kind}" if state else None)
            found = [r.asDict() for r in res.orderBy("cv_mae").collect()] + [{"best": {p.name: v for p, v in best.items()}}]
        print(json.dumps({"part": part, "sf": sf_dir, **rows, "settings": settings, "seconds": round(time.time() - t0, 1), "found": found}),
              flush=True)
    remove_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
