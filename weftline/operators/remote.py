"""Remote and model operators: translators, scorers and subprocesses are injected; work runs in Arrow batches.

Rows go through mapInArrow partition by partition: as many requests are in flight as there are tasks times workers, each
refilled as one ends. A row that fails after its retries comes back with its error, and is set aside by the quarantine writer.
"""

from __future__ import annotations

import subprocess
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: texts, source and target language -> translations, in order.
BatchTranslator = Callable[[Sequence[str], str, str], Sequence[str]]
#: One request -> its answer.
Translator = Callable[[str], str]
Scorer = Callable[[Sequence[str], Sequence[str], Sequence[str]], Sequence[float]]


def wait_seconds(attempt: int, rate_limited: bool = False, most: float = 10.0) -> float:
    """Linear back-off: two seconds a try, five when the provider limits the rate."""
    return min(5.0 * (attempt + 1), 30.0) if rate_limited else min(2.0 * (attempt + 1), most)


def with_retries(call: Callable[[], str], retries: int, pause: Callable[[float], None] = time.sleep) -> str:
    """call's answer; an empty one is an error like any other. Raises the last error."""
    for attempt in range(retries + 1):
        try:
            answer = call()
            if not answer or not answer.strip():
                raise ValueError("empty answer")
            return answer.strip()
        except Exception as error:
            if attempt == retries:
                raise
            text = str(error).lower()
            pause(wait_seconds(attempt, "429" in text or "rate limit" in text or "too many requests" in text))
    raise AssertionError


# Names of model families, and the request fields that keep their thoughts out of the answer.
FAMILY_OPTIONS = (
    (("qwen3", "qwen", "qwen3-4b"), {"chat_template_kwargs": {"enable_thinking": False}}),
    (("zhipu", "glm", "glm4", "glm5"), {"thinking": {"type": "disabled"}}),
    (("deepseek",), {"thinking": {"type": "disabled"}}),
    (("minimax", "m2", "m2.7"), {"reasoning_split": True}),
)


def request_options(model_family: str | None) -> dict | None:
    """Extra request fields of a model family; None for others."""
    return next((dict(fields) for known, fields in FAMILY_OPTIONS if (model_family or "").lower() in known), None)


def windowed(batches: Iterator[pa.RecordBatch], column: int, call: Callable[[str | None], object], inflight: int, most_open: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch with call's results for one of its columns, in the order they came.

    At most inflight calls are open. Whenever one ends, the next row is asked for, of the same batch or of a later one, so a
    slow call keeps one place and no other; at most most_open batches are held for a slow row of the first.
    """
    open_batches: deque[tuple[pa.RecordBatch, list, list[int]]] = deque()  # batch, results, how many are missing
    running: dict[Future, tuple[list, list[int], int]] = {}

    def requests() -> Iterator[tuple[list, list[int], int, str | None]]:
        for batch in batches:
            texts = batch.column(column).to_pylist()
            results: list = [None] * len(texts)
            missing = [len(texts)]
            open_batches.append((batch, results, missing))
            for i, text in enumerate(texts):
                yield results, missing, i, text

    with ThreadPoolExecutor(inflight) as pool:
        todo, ended = requests(), False
        while True:
            while not ended and len(running) < inflight and len(open_batches) <= most_open:
                one = next(todo, None)
                if one is None:
                    ended = True
                else:
                    results, missing, i, text = one
                    running[pool.submit(call, text)] = results, missing, i
            while open_batches and not open_batches[0][2][0]:
                batch, results, _ = open_batches.popleft()
                yield batch, results
            if running:
                for done in wait(running, return_when=FIRST_COMPLETED).done:
                    results, missing, i = running.pop(done)
                    results[i] = done.result()
                    missing[0] -= 1
            elif ended:
                return


def translate(items: DataFrame, translator: Translator, prompt_col: str, out_col: str = "hypothesis", workers: int = 4, retries: int = 3, most_open: int = 8) -> DataFrame:
    """items with out_col and error. Each row is a request, workers of a partition are open at a time (see windowed); order is kept."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields if f.name not in (out_col, "error"))
    rows = items.drop(out_col, "error")
    at = rows.columns.index(prompt_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(text: str | None) -> tuple[str | None, str | None]:
            try:
                return with_retries(lambda: translator(text or ""), retries), None
            except Exception as error:
                return None, str(error)

        for batch, found in windowed(batches, at, one, workers, most_open):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=[*batch.schema.names, out_col, "error"])

    return rows.mapInArrow(run, f"{fields}, `{out_col}` string, error string")


def length_batches(lengths: Sequence[int], budget: int, most: int | None = None) -> list[list[int]]:
    """Places of the items in batches: items of like length together, so that a batch's items, padded to its longest, hold budget tokens at most (or it is one item), and no more than most of them."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        longest = max(lengths[out[-1][0]], 1) if out else 0
        if out and (len(out[-1]) + 1) * longest <= budget and (most is None or len(out[-1]) < most):
            out[-1].append(i)
        else:
            out.append([i])
    return out


def padding(lengths: Sequence[int], batches: Sequence[Sequence[int]]) -> float:
    """The part of the batches' tokens that is padding."""
    held = sum(max(lengths[i] for i in b) * len(b) for b in batches)
    return 1 - sum(lengths) / held if held else 0.0


def pooled(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to some rows or more, so that there is choice among lengths."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(map(len, kept)) >= rows:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept = []
    if sum(map(len, kept)):
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def count_words(text: str) -> int:
    return len(text.split())


def in_length_batches(items: DataFrame, call: BatchTranslator, token_budget: int = 4096, tokens: Callable[[str], int] = count_words, text_col: str = "source_text", out_col: str = "hypothesis", most: int | None = None, pool_rows: int = 10_000) -> DataFrame:
    """items with out_col: texts of a direction (src_lang, tgt_lang) and like length are called together, under a budget of padded tokens; each answer goes back to its row.

    call gets texts and languages and must give as many answers. A partition's rows are pooled by pool_rows, then cut into
    length_batches; rows keep their order. Null texts count as empty ones.
    """
    rows = items.drop(out_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    at = {c: rows.columns.index(c) for c in (text_col, "src_lang", "tgt_lang")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pooled(batches, pool_rows):
            texts = [t or "" for t in batch.column(at[text_col]).to_pylist()]
            directions: dict[tuple, list[int]] = {}
            for i, pair in enumerate(zip(batch.column(at["src_lang"]).to_pylist(), batch.column(at["tgt_lang"]).to_pylist(), strict=True)):
                directions.setdefault(pair, []).append(i)
            out: list[str | None] = [None] * len(texts)
            for (src, tgt), own in directions.items():
                for part in length_batches([tokens(texts[i]) for i in own], token_budget, most):
                    places = [own[k] for k in part]
                    for i, answer in zip(places, call([texts[i] for i in places], src, tgt), strict=True):
                        out[i] = answer
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, out_col])

    return rows.mapInArrow(run, f"{fields}, `{out_col}` string")


def translate_batches(items: DataFrame, translator: BatchTranslator, text_col: str = "source_text", out_col: str = "hypothesis", batch_size: int = 32) -> DataFrame:
    """items with out_col, by direction in batches of fixed size. Rows of a direction are salted over tasks, so a large one doesn't wait for one task."""
    rows = items.drop(out_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    at = {c: rows.columns.index(c) for c in (text_col, "src_lang", "tgt_lang")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, srcs, tgts = (batch.column(at[c]).to_pylist() for c in (text_col, "src_lang", "tgt_lang"))
            out: list[str | None] = [None] * len(texts)
            groups: dict[tuple, list[int]] = {}
            for i, pair in enumerate(zip(srcs, tgts, strict=True)):
                groups.setdefault(pair, []).append(i)
            for (src, tgt), places in groups.items():
                for k in range(0, len(places), batch_size):
                    part = places[k : k + batch_size]
                    for i, text in zip(part, translator([texts[i] or "" for i in part], src, tgt), strict=True):
                        out[i] = text
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, out_col])

    salt = F.pmod(F.xxhash64(text_col), F.lit(16))
    return rows.repartition("src_lang", "tgt_lang", salt).mapInArrow(run, f"{fields}, `{out_col}` string")


def translate_chunks(chunks: DataFrame, translator: Translator, workers: int = 4) -> DataFrame:
    """chunks with draft, the translations of their src_lines; a chunk in which one line fails goes."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    at = chunks.columns.index("src_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines(texts: list[str]) -> list[str] | None:
            try:
                return [translator(t).strip() for t in texts]
            except Exception:
                return None

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                found = pa.array(list(pool.map(lines, batch.column(at).to_pylist())), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "draft"]).filter(found.is_valid())

    return chunks.mapInArrow(run, f"{fields}, draft array<string>")


def score_segments(rows: DataFrame, scorer: Scorer, id_col: str, token_budget: int | None = None, tokens: Callable[[str], int] = count_words, pool_rows: int = 10_000) -> DataFrame:
    """id, score: segment scores joined by id, never by place. A scorer that gives another number of scores is an error.

    With a token budget, segments of like length (of all three texts) are scored together, padded to that many tokens at most.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pooled(batches, pool_rows) if token_budget else batches:
            texts = [batch.column(i).to_pylist() for i in (1, 2, 3)]
            parts = length_batches([sum(tokens(t or "") for t in row) for row in zip(*texts, strict=True)], token_budget) if token_budget else [range(len(batch))]
            scores: list[float | None] = [None] * len(batch)
            for part in parts:
                found = list(scorer(*([column[i] for i in part] for column in texts)))
                if len(found) != len(part):
                    raise ValueError(f"{len(found)} scores for {len(part)} rows")
                for i, score in zip(part, found, strict=True):
                    scores[i] = score
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    return rows.select(id_col, "source_text", "hypothesis", "reference_text").mapInArrow(run, f"`{id_col}` {kind}, score double")


def subprocess_translator(command: Sequence[str], timeout: float = 60.0) -> Translator:
    """A translator that sends one line to a command's standard input; a failing command is an error."""

    def run(text: str) -> str:
        line = " ".join((text or "").splitlines()).strip()
        done = subprocess.run(list(command), input=line + "\n", text=True, capture_output=True, timeout=timeout, check=False)
        if done.returncode:
            raise RuntimeError(f"exit {done.returncode}: {done.stderr.strip()}")
        return done.stdout.strip()

    return run


def translate_lines(items: DataFrame, command: Sequence[str], text_col: str = "source_text", out_col: str = "hypothesis", ahead: int = 64) -> DataFrame:
    """items with out_col by a command that answers each line with a line: one process a partition, which reads ahead lines before the first must be answered.

    Line ends within a text become blanks; a null or empty text is an empty line. A command that ends early, gives too few or
    too many lines, or exits with an error fails the task.
    """
    rows = items.drop(out_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process = None
        try:
            for batch in batches:
                if process is None and len(batch):
                    process = subprocess.Popen(list(command), stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8", bufsize=1)
                texts = [" ".join((t or "").splitlines()).strip() for t in batch.column(at).to_pylist()]
                out, sent = [], 0
                while len(out) < len(texts):
                    try:
                        while sent < min(len(texts), len(out) + ahead):
                            process.stdin.write(texts[sent] + "\n")
                            sent += 1
                        process.stdin.flush()
                    except BrokenPipeError:
                        pass  # it has ended: reading tells how
                    line = process.stdout.readline()
                    if not line:
                        raise RuntimeError(f"{command[0]} ended with exit status {process.wait()} before its lines did")
                    out.append(line.rstrip("\n"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, out_col])
            if process is not None:
                process.stdin.close()
                more = process.stdout.read()
                if process.wait() or more:
                    raise RuntimeError(f"{command[0]}: exit status {process.returncode}" if process.returncode else f"{command[0]} gave more lines than it got")
        finally:
            if process is not None and process.poll() is None:
                process.kill()
                process.wait()

    return rows.mapInArrow(run, f"{fields}, `{out_col}` string")


def agent_messages(text: str, src: str, tgt: str, hint: str = "") -> list[dict]:
    """System and user messages of a translation agent with a dictionary at hand."""
    from ..functions.names import name_of

    system = f"You translate {name_of(src)} into {name_of(tgt)}. Look up terms in the dictionary where you are unsure. Output only the translation." + (f" Directions: {hint}" if hint else "")
    return [{"role": "system", "content": system}, {"role": "user", "content": text}]


def run_agent(ask: Callable[[list[dict]], dict], tools: dict[str, Callable], messages: list[dict], rounds: int = 8) -> str:
    """Asks until an answer calls no tool, at most rounds times; unknown tools and their errors go back as data."""
    history = list(messages)
    for _ in range(rounds):
        answer = ask(history)
        calls = answer.get("tool_calls") or []
        if not calls:
            return (answer.get("content") or "").strip()
        history.append(answer)
        for call in calls:
            try:
                result = tools[call["name"]](**call.get("arguments", {})) if call["name"] in tools else {"error": f"unknown tool: {call['name']}"}
            except Exception as error:
                result = {"error": str(error)}
            history.append({"role": "tool", "name": call["name"], "content": result})
    return (history[-1].get("content") or "") if isinstance(history[-1].get("content"), str) else ""
