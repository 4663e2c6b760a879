"""robots.txt for a client that reads one file at a time; operators/robots.py holds the same rules against many hosts."""

from __future__ import annotations

from itertools import groupby
from typing import NamedTuple


class Rule(NamedTuple):
    agent: str
    allow: bool
    pattern: str


def token(agent: str) -> str:
    return agent.partition("/")[0].strip().lower()


def parse(text: str) -> list[Rule]:
    """A rule for each agent of its group. A group is a run of user-agent lines and the run of rules after it; rules without a pattern say nothing."""
    split = (line.partition("#")[0].partition(":") for line in text.splitlines())
    lines = [(name.strip().lower(), value.strip()) for name, colon, value in split if colon]
    runs = groupby((x for x in lines if x[0] in ("user-agent", "allow", "disallow")), key=lambda x: x[0] == "user-agent")
    rules, agents = [], []
    for names_agents, run in runs:
        if names_agents:
            agents = [token(value) for _, value in run]
        else:
            said = [(name == "allow", value) for name, value in run if value]
            rules += [Rule(agent, allow, pattern) for agent in agents for allow, pattern in said]
    return rules


def fits(pattern: str, path: str) -> bool:
    """Whether a path starts as the pattern says: * is anything, a $ at the end is the path's end."""
    ends = pattern.endswith("$")
    head, *rest = pattern.removesuffix("$").split("*")
    if not path.startswith(head):
        return False
    at = len(head)
    last = rest.pop() if ends and rest else None
    for part in rest:
        at = path.find(part, at)
        if at < 0:
            return False
        at += len(part)
    if last is not None:
        return path.endswith(last) and len(path) - len(last) >= at
    return at == len(path) if ends else True


def allowed(rules: list[Rule], agent: str, path: str) -> bool:
    """By the longest pattern that fits, an allow winning a tie; an agent without rules of its own has those of *."""
    own = [r for r in rules if r.agent == token(agent)] or [r for r in rules if r.agent == "*"]
    return max(((len(r.pattern), r.allow) for r in own if fits(r.pattern, path)), default=(0, True))[1]
