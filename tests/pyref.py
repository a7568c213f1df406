"""Plain-Python rendering of the cleaning specification (the fixed patterns, Python re
semantics), used as the test oracle for the Spark expressions."""

import re

# The cleaning chain with Python's own Unicode classes.
_PY_STEPS = [
    (r"[a-zA-Z0-9-_.]+@[a-zA-Z0-9-_.]+", ""),
    (r"((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(\.|$)){4}", ""),
    (r"http\S+", ""),
    (r"www\S+", ""),
    (r"[#,@,&,<,>,\,/,-]", ""),
    (r"[^\w\s#@/:%.,_-]", ""),
    (r"\[", ""),
    (r"\]", ""),
    (r"\n", " "),
    (r"\t", " "),
    (r" {2,}", " "),
]


def py_clean(s):
    if s is None:
        return None
    for pat, rep in _PY_STEPS:
        s = re.sub(pat, rep, s)
    s = s.lower().strip()
    return re.sub(r"\d", "", s)
