import os
import re

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_outside_the_subpackage_imports_it():
    for base, _, names in os.walk(os.path.join(ROOT, "lychnos")):
        if os.path.basename(base) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                assert not re.search(r"lychnos\.llm|from lychnos import llm", open(os.path.join(base, n)).read()), n
