import pytest

from tessera.llm import license_scan as S


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("// SPDX-License-Identifier: MIT OR Apache-2.0\ncode", ["MIT", "Apache-2.0"]),
        ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */ int x;", ["MIT", "Apache-2.0"]),
        ("SPDX-LICENSE-IDENTIFIER: MIT", ["MIT"]),
        ("# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 AND (BSD-3-Clause or (Zlib AND LicenseRef-x))\r\nMIT", ["GPL-2.0-only", "Classpath-exception-2.0", "BSD-3-Clause", "Zlib", "LicenseRef-x"]),
        ("<!-- SPDX-License-Identifier: MIT --> OR Zlib", ["MIT"]),
        ("SPDX-License-Identifier: GPL-2.0+\nSPDX-License-Identifier:\nZlib", ["GPL-2.0+"]),
    ],
)
def test_expressions(text, want):
    assert S.scan_text(text) == [(k, "spdx-tag", -1, -1) for k in want]
