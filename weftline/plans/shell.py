"""Prompts typed one at a time."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.report import workflow_lines

LEAVE = ("exit", "quit", "q")


def converse(plan: Callable, spark, read: Callable[[str], str] = input, write: Callable[[str], None] = print) -> int:
    """Plan each line until exit, quit, q or the end of the input; `debug` turns whole documents on and off. A failed prompt is told and the next one read.

    plan: prompts (prompt_id, text) to workflow documents. Returns the number of prompts planned."""
    done, debug = 0, False
    while True:
        try:
            text = read("prompt> ").strip()
        except EOFError:
            return done
        word = text.lower()
        if word in LEAVE:
            return done
        if word == "debug":
            debug = not debug
            write(f"debug {'on' if debug else 'off'}")
            continue
        if not text:
            write("type a prompt, or exit")
            continue
        try:
            found = plan(spark.createDataFrame([(str(done), text)], "prompt_id string, text string")).cache()
            for r in found.toJSON().collect() if debug else [x.line for x in workflow_lines(found).orderBy("at").collect()]:
                write(r)
            found.unpersist()
            done += 1
        except Exception as e:  # one prompt must not end the session
            write(f"failed: {e}")
