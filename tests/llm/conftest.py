import pytest

pytest.importorskip("posemill.llm")
