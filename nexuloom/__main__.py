"""``python -m nexuloom graph --kg DIR --profile FILE --seeds A,B --out DIR``: a context graph from the command line."""

from __future__ import annotations

import argparse
import json

from . import api
from .operators.context import Params
from .session import session


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="nexuloom")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("graph", help="expand seeds into a context graph")
    e = sub.add_parser("enrich", help="terms over-represented among genes")
    for x in (g, e):
        x.add_argument("--kg", required=True)
    g.add_argument("--profile", required=True)
    g.add_argument("--seeds", required=True)
    g.add_argument("--out")
    g.add_argument("--find", default="")
    d = Params()
    for name in ("hops", "hub_cap", "per_category_cap", "max_connectivity_passes"):
        g.add_argument(f"--{name.replace('_', '-')}", type=int, default=getattr(d, name))
    for name in ("alpha", "score_floor_percentile", "min_edge_weight"):
        g.add_argument(f"--{name.replace('_', '-')}", type=float, default=getattr(d, name))
    g.add_argument("--directionality", choices=["", "on", "off"], default="")
    e.add_argument("--genes", required=True)
    a = p.parse_args(argv)
    spark = session()
    if a.command == "graph":
        params = Params(hops=a.hops, hub_cap=a.hub_cap, per_category_cap=a.per_category_cap, max_connectivity_passes=a.max_connectivity_passes, alpha=a.alpha, score_floor_percentile=a.score_floor_percentile, min_edge_weight=a.min_edge_weight, directionality=a.directionality)
        out = api.run_context_graph(spark, a.kg, [api.Seed(s) for s in a.seeds.split(",")], api.load_profile(spark, a.profile), params, a.out, [x for x in a.find.split(",") if x])
        print(json.dumps(out, indent=1, default=str))
    else:
        api.enrich(spark, a.kg, a.genes.split(",")).show(60, truncate=False)


if __name__ == "__main__":
    main()
