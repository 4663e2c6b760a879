"""Commands over a register's folder: ``python -m corpuswatch.cli --folder F COMMAND``.

Exit codes: 0 done, 1 a problem was found or an argument is bad, 2 refused. Whatever files or pages say is printed with its unprintable characters escaped.
"""

from __future__ import annotations

import argparse
import importlib.util
import json
import os
import ssl
import sys
from datetime import date

from .functions.html import printable
from .operators import status
from .register import Register, checked_date
from .schema import ACTIONS
from .sources.frontmatter import FrontmatterError
from .sources.register import RegisterError, UnsafePath


def prerequisites() -> list[str]:
    """What is missing on this machine, without raising."""
    missing = [f"{name} is not installed" for name in ("yaml", "pyspark", "pyarrow") if importlib.util.find_spec(name) is None]
    if not ssl.create_default_context().cert_store_stats()["x509_ca"] and not os.environ.get("SSL_CERT_FILE"):
        missing.append("there are no CA certificates: pages can't be fetched over https")
    return missing


def say(text: object, to=None) -> None:
    print(printable(str(text)), file=to or sys.stdout)


def as_json(value: object) -> None:
    print(json.dumps(value, indent=2, default=str))


def rows_of(df) -> list[dict]:
    return [{k: v for k, v in r.asDict(True).items() if v is not None} for r in df.collect()]


def cmd_init(reg: Register, args) -> int:
    reg.init()
    return 0


def cmd_status(reg: Register, args) -> int:
    row = reg.status()
    if args.json:
        as_json(row)
    else:
        for line in status.render(row).splitlines():
            say(line)
    return 0


def cmd_pending(reg: Register, args) -> int:
    rows = sorted(rows_of(reg.open()), key=lambda r: (len(r["id"]), r["id"]))
    if args.json:
        as_json(rows)
    for r in () if args.json else rows:
        say(f"{r['id']} [{r.get('severity')}] {r.get('kind')}: {r.get('summary', '')}")
    return 0


def cmd_resolve(reg: Register, args) -> int:
    verdict = reg.resolve(args.id, args.action, args.by, args.today, args.note or "")
    if verdict != "ok":
        say(f"{args.id}: {verdict}", sys.stderr)
    return int(verdict != "ok")


def cmd_search(reg: Register, args) -> int:
    rows = rows_of(reg.search(args.query, args.k, args.kind).orderBy("score", ascending=False))
    if args.json:
        as_json(rows)
    for r in () if args.json else rows:
        say(f"{r['score']:.3f} {r['path']} ({r['kind']})")
        say(f"  {r['snippet']}")
    return 0


def listed(texts: list[str]) -> int:
    for text in texts:
        say(text)
    return int(bool(texts))


def cmd_profile_validate(reg: Register, args) -> int:
    return listed([r["problem"] for r in reg.profile_problems().collect()])


def cmd_profile_diff(reg: Register, args) -> int:
    for slug in reg.profile_diff(args.against):
        say(slug)
    return 0


def cmd_regimes_validate(reg: Register, args) -> int:
    return listed([f"{r['path']}: {r['problem']}" for r in reg.regime_problems().collect()])


def cmd_sources_validate(reg: Register, args) -> int:
    return listed([r["problem"] for r in reg.source_problems().collect()])


def details(report: dict) -> None:
    for id, text in report["details"].items():
        say(f"  {id}: {text}")


def cmd_check(reg: Register, args) -> int:
    report = reg.check(args.today, args.source)
    if args.json:
        as_json(report)
    else:
        say(f"fresh {report['fresh']} · moved {report['moved']} · unreachable {report['unreachable']}")
        details(report)
    return report["exit"]


def cmd_fetch(reg: Register, args) -> int:
    report = reg.fetch(args.today, args.source, args.force)
    say(f"written {report['written']} · skipped {report['skipped']} · refused {len(report['refused'])}")
    details(report)
    return report["exit"]


def cmd_rescan(reg: Register, args) -> int:
    report = reg.rescan(args.today)
    if report.get("error"):
        say(report["error"], sys.stderr)
    else:
        say(f"changed: {', '.join(report['changed']) or 'nothing'} · entries filed: {report['entries']}")
    return report["exit"]


def iso(text: str) -> str:
    try:
        return checked_date(text)
    except ValueError as error:
        raise argparse.ArgumentTypeError(str(error)) from error


def parser() -> argparse.ArgumentParser:
    whole = argparse.ArgumentParser(prog="corpuswatch")
    whole.add_argument("--folder", default=".", help="the register's folder")
    commands = whole.add_subparsers(dest="command")

    def add(to, name: str, run, *options: tuple[tuple, dict]) -> None:
        command = to.add_parser(name)
        for names, how in options:
            command.add_argument(*names, **how)
        command.set_defaults(run=run)

    flag = lambda name: ((f"--{name}",), {"action": "store_true"})
    today = (("--today",), {"type": iso, "default": date.today().isoformat()})
    sources = (("--source",), {"action": "append"})
    add(commands, "init", cmd_init)
    add(commands, "status", cmd_status, flag("json"))
    add(commands, "pending", cmd_pending, flag("json"))
    add(commands, "resolve", cmd_resolve, (("id",), {}), (("--action",), {"required": True, "choices": ACTIONS}), (("--by",), {"required": True}), (("--note",), {}), today)
    add(commands, "search", cmd_search, (("query",), {}), (("-k",), {"type": int, "default": 5}), (("--kind",), {"choices": ("regime", "mirror", "profile")}), flag("json"))
    add(commands, "check", cmd_check, sources, flag("json"), today)
    add(commands, "fetch", cmd_fetch, sources, flag("force"), today)
    add(commands, "rescan", cmd_rescan, today)
    for name, run in (("profile", cmd_profile_validate), ("regimes", cmd_regimes_validate), ("sources", cmd_sources_validate)):
        part = commands.add_parser(name).add_subparsers(dest="part", required=True)
        add(part, "validate", run)
        if name == "profile":
            add(part, "diff", cmd_profile_diff, (("--against",), {"required": True, "help": "a file or a git reference"}))
    return whole


def main(argv: list[str] | None = None, register: Register | None = None) -> int:
    """``register`` stands for the one in the folder, in tests."""
    commands = parser()
    try:
        args = commands.parse_args(argv)
    except SystemExit as stop:
        return 1 if stop.code else 0
    if not args.command:
        commands.print_help(sys.stderr)
        return 1
    missing = prerequisites() if register is None else []
    if args.command != "init" and not os.path.isdir(args.folder):
        missing.append(f"{args.folder} is no folder")
    for text in missing:
        say(f"refused: {text}", sys.stderr)
    if missing:
        return 2
    try:
        if register is None:
            from .session import session

            register = Register(session(), args.folder)
        return args.run(register, args)
    except UnsafePath as error:
        say(f"refused: {error}", sys.stderr)
        return 2
    except (FrontmatterError, RegisterError) as error:
        say(f"error: {error}", sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
