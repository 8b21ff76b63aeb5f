"""Sinks: tables by Spark's writers, messages and exports as payloads for an injected sender.

Messages are made of a handful of rows; only these reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor, wait

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import reference_data as ref
from tidemark.functions import text as T
from tidemark.functions.patterns import filled

EXPORT_CAP, DIGEST_ROWS, CELL, TITLE, BODY = 500, 5, 300, 200, 100_000
EMBEDS_A_MESSAGE, CHARS_A_MESSAGE = 10, 4096
SEND_SECONDS = 15.0
COLORS = {"NEW": 0x22C55E, "UPDATED": 0xF59E0B}
OTHER_COLOR = 0x3B82F6
#: Which tools an export may use, in order of preference; read-only and destructive names are never used.
TARGETS = (
    ("notion", r"create[-_ ]?pages?"),
    ("sheet", r"append[-_ ]?row|add[-_ ]?row|insert[-_ ]?row|append[-_ ]?values"),
    ("slack", r"post[-_ ]?message|send[-_ ]?message|chat[._ ]?post"),
    ("issue", r"\b(?:create|save|new)[-_ ]?issues?\b"),
)
DENIED = r"label|comment|attachment|database|duplicate|(?<![a-z0-9])(?:update|delete|remove|archive|move)"


def write(items: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Write postings as parquet, json or csv; in csv, arrays and structs are JSON texts."""
    if kind == "csv":
        nested = [f.name for f in items.schema.fields if f.dataType.typeName() in ("array", "struct")]
        items = items.withColumns({c: F.to_json(c) for c in nested})
    items.write.format(kind).mode(mode).options(**({"header": True} if kind == "csv" else {})).save(path)


def to_notify(items: DataFrame, only_changes: bool, incremental: bool) -> DataFrame:
    """The rows worth a message: new and updated ones, if only changes of an incremental run are asked for."""
    return items.where(F.col("changeType").isin("NEW", "UPDATED")) if only_changes and incremental else items


def one_liner(company: Column, low: Column, high: Column, currency: Column, location: Column, employment: Column,
              change: Column, escape: Callable[[Column], Column] = lambda c: c) -> Column:
    """company · pay · place · kind of employment · [change]; what is missing is left out."""
    changed = F.when(filled(change).isNotNull() & (change != "UNCHANGED"), F.concat(F.lit("["), change, F.lit("]")))
    return F.concat_ws(" · ", escape(filled(company)), T.salary_range(low, high, currency), escape(filled(location)),
                       escape(filled(employment)), changed)


def message_rows(items: DataFrame, limit: int = 5) -> list[dict]:
    """The first rows with what messages need, made by Spark; items must be ordered."""
    c = F.col
    rows = items.limit(limit).select(
        "title", "applyUrl", "company", "location", "employmentType", "description", "postedAt", "changeType",
        T.salary_range(c("salaryMin"), c("salaryMax"), c("salaryCurrency")).alias("salary"),
        *(one_liner(c("company"), c("salaryMin"), c("salaryMax"), c("salaryCurrency"), c("location"), c("employmentType"),
                    c("changeType"), f).alias(n) for n, f in (("line", lambda x: x), ("line_md", T.escape_markdown), ("line_slack", T.escape_slack))),
        T.escape_markdown(c("title")).alias("title_md"), T.escape_slack(c("title")).alias("title_slack"),
    )
    return [r.asDict() for r in rows.collect()]


def _plain(rows: list[dict], head: str | None, title: str, line: str, mark: str, none: str) -> str:
    out = [head, ""] if head else []
    for r in rows:
        out += [x for x in (f"{mark}{r[title] if r[title] is not None else none}{mark}", r[line], r["applyUrl"]) if x] + [""]
    return "\n".join(out).strip()


def _md(text: str) -> str:
    return re.sub(r"([_*\[\]`])", r"\\\1", text)


def telegram(rows: list[dict], label: str | None = None, total: int = 0) -> str:
    head = f"📊 *{_md(label)} — {total} result(s)*" if label is not None else None
    return _plain(rows, head, "title_md", "line_md", "*", "(untitled)")


def whatsapp(rows: list[dict], label: str | None = None, total: int = 0) -> list[str]:
    """Texts of at most CHARS_A_MESSAGE characters."""
    head = f"📊 {label} — {total} result(s)" if label is not None else None
    text = _plain(rows, head, "title", "line", "", "(untitled)")
    return [text[i : i + CHARS_A_MESSAGE] for i in range(0, len(text), CHARS_A_MESSAGE)]


def slack(rows: list[dict], label: str | None = None, total: int = 0) -> dict:
    section = lambda text: {"type": "section", "text": {"type": "mrkdwn", "text": text}}
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    blocks = [section(f"📊 *{esc(label)}* — {total} result(s)"), {"type": "divider"}] if label is not None else []
    for r in rows:
        title = r["title_slack"] if r["title_slack"] is not None else "(untitled)"
        linked = f"<{r['applyUrl']}|{title}>" if r["applyUrl"] else title
        blocks.append(section(f"*{linked}*" + (f"\n{r['line_slack']}" if r["line_slack"] else "")))
    return {"blocks": blocks}


def discord(rows: list[dict], label: str | None = None, total: int = 0) -> list[dict]:
    """Messages of at most EMBEDS_A_MESSAGE embeds; the first has the heading."""
    def embed(r: dict) -> dict:
        named = (("Company", r["company"]), ("Salary", r["salary"]), ("Location", r["location"]), ("Type", r["employmentType"]))
        text = r["description"]
        out = {"title": (r["title"] if r["title"] is not None else "(untitled)")[:256], "url": r["applyUrl"] or None,
               "description": (text[:300] + "…" * (len(text) > 300)) if text else None,
               "color": COLORS.get(r["changeType"], OTHER_COLOR),
               "fields": [{"name": n, "value": v, "inline": True} for n, v in named if v],
               "footer": {"text": f"Posted {r['postedAt'][:10]}"} if r["postedAt"] else None}
        return {k: v for k, v in out.items() if v is not None}

    embeds = [embed(r) for r in rows]
    head = f"📊 **{label}** — {total} result(s)" if label is not None else ""
    return [{"content": head if i == 0 else "", "embeds": embeds[i : i + EMBEDS_A_MESSAGE]}
            for i in range(0, max(len(embeds), 1), EMBEDS_A_MESSAGE)]


def webhook(rows: list[dict], label: str | None = None, total: int = 0) -> dict:
    return {"metadata": None if label is None else {"searchLabel": label, "totalEmitted": total}, "items": rows}


FORMATS: dict[str, Callable] = {"telegram": telegram, "discord": discord, "slack": slack, "whatsapp": whatsapp, "webhook": webhook}


def notify(rows: list[dict], senders: dict[str, Callable[[object], None]], label: str | None, total: int,
           seconds: float = SEND_SECONDS) -> tuple[list[str], dict[str, str]]:
    """(sent, failed): each platform's payload goes to its sender, all at once; one that fails or takes longer than
    seconds does not stop the others."""
    sent, failed = [], {}
    if not rows or not senders:
        return sent, failed
    pool = ThreadPoolExecutor(len(senders))
    running = {p: pool.submit(lambda p=p, send=send: send(FORMATS[p](rows, label, total))) for p, send in senders.items()}
    wait(running.values(), seconds)
    for platform, future in running.items():
        error = future.exception() if future.done() else TimeoutError(f"no answer in {seconds:g} seconds")
        if error is None:
            sent.append(platform)
        else:
            failed[platform] = str(error)
    pool.shutdown(wait=False)
    return sent, failed


def classify_target(tools: Iterable[str]) -> tuple[str, str] | None:
    """(kind, tool) of the first tool that an export may use; None where no tool is known."""
    usable = [t for t in tools if isinstance(t, str) and not re.search(DENIED, t, re.I)]
    return next(((kind, t) for kind, pattern in TARGETS for t in usable if re.search(pattern, t, re.I)), None)


def project(records: list[dict], columns: list[tuple[str, str]] | None = None) -> list[dict[str, str]]:
    """Scalar values as texts: of the named columns under their labels, or of all."""
    def text(v: object) -> str | None:
        if isinstance(v, bool):
            return "true" if v else "false"
        return str(v) if isinstance(v, (int, float)) or (isinstance(v, str) and v) else None

    pairs = lambda r: [(label, r.get(key)) for label, key in columns] if columns else r.items()
    return [{k: t for k, v in pairs(r) if (t := text(v)) is not None} for r in records]


def digest(records: list[dict], noun: str, term: str | None = None, place: str | None = None) -> str:
    """How many records there are, and the first few by name."""
    head = f"Found {len(records)} {noun}" + (f' for "{term}"' if term else "") + (f" in {place}" if place else "") + "."
    first = lambda r: next((r[k] for k in ("title", "name") if r.get(k) is not None), "Result")
    top = [f"{i}. {first(r)}" + (f" — {r['city']}" if r.get("city") else "") + (f" ({r['leadTier']})" if r.get("leadTier") else "")
           for i, r in enumerate(records[:DIGEST_ROWS], 1)]
    return "\n".join([head, f"Top {len(top)}:", *top]) if top else head


def _printable(text: str) -> str:
    return "".join(c for c in text if ord(c) >= 32 and ord(c) != 127)


def cell(text: str) -> str:
    """A text that can stand in a Markdown table."""
    safe = _printable(text).replace("`", "'").replace("|", "\\|").replace("[", "(").replace("]", ")")
    safe = " ".join(safe.split())
    return safe if len(safe) <= CELL else safe[: CELL - 1] + "…"


def markdown_table(rows: list[dict[str, str]], columns: list[tuple[str, str]] | None = None) -> str:
    """Rows as a Markdown table of bounded size; what does not fit is counted in its last line."""
    labels = [label for label, _ in columns] if columns else list(rows[0]) if rows else []
    if not labels:
        return ""
    line = lambda cells: f"| {' | '.join(cells)} |"
    lines = [line(map(cell, labels)), line("---" for _ in labels)]
    size = sum(map(len, lines))
    for i, row in enumerate(rows):
        text = line(cell(row.get(label, "")) for label in labels)
        if size + len(text) > BODY:
            lines.append(line([f"…and {len(rows) - i} more", *[""] * (len(labels) - 1)]))
            break
        lines.append(text)
        size += len(text) + 1
    return "\n".join(lines)


def export_once(store, marker: str, records: list[dict], *args, now: str, **kwargs) -> dict:
    """:func:`export`, unless the marker in the store says that these records were sent before.

    The marker is set when something was sent and nothing failed, so that a run that is resumed sends nothing twice.
    """
    if store.read(marker):
        return {"exported": 0, "errors": 0, "skipped": len(records), "target": "done"}
    result = export(records, *args, **({"columns": list(ref.CONNECTOR_COLUMNS)} | kwargs))
    if result["exported"] > 0 and result["errors"] == 0:
        store.write(marker, {"at": now})
    return result


def export(records: list[dict], tools: Iterable[str], call: Callable[[str, dict], object], noun: str = "records", term: str | None = None,
           place: str | None = None, columns: list[tuple[str, str]] | None = None, cap: int = EXPORT_CAP, team: str | None = None,
           channel: str | None = None) -> dict:
    """Send records to a connected tool, as a page, an issue, a digest or rows; never raises.

    call returns a result; one with a true isError counts as an error.
    """
    taken, skipped = records[:cap], max(0, len(records) - cap)
    result = lambda ok, bad, kind: {"exported": ok, "errors": bad, "skipped": skipped, "target": kind}
    target = classify_target(tools)
    if target is None:
        return result(0, 0, "none")
    kind, tool = target

    def sent(arguments: dict) -> bool:
        try:
            answer = call(tool, arguments)
        except Exception:
            return False
        return not (isinstance(answer, dict) and answer.get("isError") is True)

    rows = project(taken, columns)
    title = " ".join(_printable(noun + (f": {term}" if term else "") + (f" in {place}" if place else "")).split())[:TITLE]
    whole = {
        "slack": lambda: {"text": digest(taken, noun, term, place)} | ({"channel": channel} if channel else {}),
        "notion": lambda: {"pages": [{"properties": {"title": title}, "content": markdown_table(rows, columns)}]},
        "issue": lambda: {"title": title, "description": markdown_table(rows, columns)} | ({"team": team} if team else {}),
    }
    if kind in whole:
        return result(len(taken), 0, kind) if sent(whole[kind]()) else result(0, 1, kind)
    done = [sent({"row": r}) for r in rows]
    return result(sum(done), len(done) - sum(done), kind)

