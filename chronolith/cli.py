"""Command line: python -m chronolith.cli STORE COMMAND ..., results as JSON."""

from __future__ import annotations

import argparse
import dataclasses
import json
import shlex
import sys

from chronolith.engine import InvalidInput, MemoryEngine, Query
from chronolith.operators.reconstruct import best_candidate
from chronolith.operators.retrieve import BLEND
from chronolith.providers import command_distiller, command_policy
from chronolith.runtime import local_session
from chronolith.store import Store, StoreError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronolith")
    p.add_argument("store")
    p.add_argument("--distiller-command", help="a command that distils events by JSON on its standard streams; by markers without it")
    p.add_argument("--distiller-timeout-ms", type=int, default=25_000)
    p.add_argument("--max-repairs", type=int, default=1)
    p.add_argument("--reconstructor-command", help="a command that decides each step of a reconstruction; the best candidate without it")
    p.add_argument("--reconstructor-timeout-ms", type=int, default=25_000)
    p.add_argument("--weight", action="append", default=[], help="PART=NUMBER of the activation blend: ppr, base, edge or fresh; repeat for more")
    sub = p.add_subparsers(dest="command", required=True)
    scope = argparse.ArgumentParser(add_help=False)
    scope.add_argument("--tenant", default="local")
    scope.add_argument("--project", default="default")
    scope.add_argument("--environment")
    for name in ("init", "health", "stats"):
        sub.add_parser(name)
    for name in ("project", "manage", "rebuild-projection"):
        sub.add_parser(name).add_argument("--limit", type=int, default=None if name == "rebuild-projection" else 1_000, help="most events of one run")
    r = sub.add_parser("remember", parents=[scope])
    r.add_argument("text")
    r.add_argument("--kind", default="fact")
    r.add_argument("--idempotency-key")
    j = sub.add_parser("import-jsonl")
    j.add_argument("path")
    for name in ("tenant", "project", "env"):
        j.add_argument(f"--{name}")
    j = sub.add_parser("import-journal", parents=[scope])
    j.add_argument("path")
    q = sub.add_parser("query", parents=[scope])
    q.add_argument("question")
    q.add_argument("--as-of", type=int)
    q.add_argument("--known-at", type=int)
    q.add_argument("--max-tokens", type=int, default=1_200)
    q.add_argument("--modes", nargs="*")
    q.add_argument("--reconstruction", default="off")
    q.add_argument("--max-steps", type=int, default=4)
    q.add_argument("--max-reconstruction-tokens", type=int, default=2_000)
    m = sub.add_parser("maintenance")
    m.add_argument("--repair-orphans", action="store_true")
    m.add_argument("--compact", action="store_true")
    m.add_argument("--prune-audit-before", type=int)
    m.add_argument("--retain-latest-audit", type=int)
    for name in ("backup", "restore"):
        sub.add_parser(name).add_argument("path")
    v = sub.add_parser("serve")
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=8080)
    v.add_argument("--token", action="append", default=[], help="TOKEN=ACTOR; repeat for more")
    e = sub.add_parser("eval")
    e.add_argument("suite")
    return p


def configured(spark, args: argparse.Namespace) -> MemoryEngine:
    """The engine with the provider, policy and weights that were asked for."""
    blend = dict(BLEND)
    for given in args.weight:
        name, _, value = given.partition("=")
        if name not in blend or not 0 <= float(value) < float("inf"):
            raise InvalidInput(f"unknown weight {given!r}")
        blend[name] = float(value)
    distiller = command_distiller(shlex.split(args.distiller_command), args.distiller_timeout_ms / 1000, args.max_repairs) if args.distiller_command is not None else None
    policy = command_policy(shlex.split(args.reconstructor_command), args.reconstructor_timeout_ms / 1000) if args.reconstructor_command is not None else best_candidate
    return MemoryEngine(spark, args.store, blend, policy, distiller)


def run(args: argparse.Namespace) -> object:
    spark = local_session()
    if args.command == "restore":
        return {"version": Store.restore(spark, args.path, args.store).manifest["version"]}
    if args.command == "eval":
        from chronolith.evaluate import run_suite

        with open(args.suite, encoding="utf-8") as f:
            return run_suite(spark, json.load(f), args.store, engine=configured(spark, args))
    engine = configured(spark, args)
    match args.command:
        case "init":
            if not engine.store.manifest["version"]:
                engine.store.publish()
            return {"version": engine.store.manifest["version"]}
        case "project" | "manage":
            return engine.project(limit=args.limit)
        case "rebuild-projection":
            return engine.rebuild(limit=args.limit)
        case "health":
            return engine.health()
        case "stats":
            return engine.stats()
        case "remember":
            out = engine.remember(args.text, args.kind, args.tenant, args.project, args.environment, idempotency_key=args.idempotency_key)
            return out | engine.project()
        case "import-jsonl":
            given = {k: v for k in ("tenant", "project", "env") if (v := getattr(args, k)) is not None}
            return engine.import_jsonl(args.path, **given) | engine.project()
        case "import-journal":
            return engine.import_journal(args.path, args.tenant, args.project, args.environment) | engine.project()
        case "query":
            query = Query(args.question, args.tenant, args.project, args.environment, args.as_of, args.known_at, args.max_tokens, args.modes, False, args.reconstruction, args.max_steps, args.max_reconstruction_tokens)
            return dataclasses.asdict(engine.ask(query))
        case "maintenance":
            return engine.maintenance(args.repair_orphans, args.compact, args.prune_audit_before, args.retain_latest_audit)
        case "serve":
            from chronolith.server import Service, serve

            serve(Service(engine, dict(t.rsplit("=", 1) for t in args.token)), args.host, args.port).serve_forever()
        case "backup":
            engine.store.backup(args.path)
            return {"backup": args.path}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print(json.dumps(run(args), indent=2, ensure_ascii=False))
    except (InvalidInput, StoreError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
