"""Input folders shared by the tests (a module of its own name, as every
``conftest.py`` of the tree would be imported as ``conftest``)."""

import os

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
# Labelled CSV fixture (116 rows, see FIXTURES.md 2.3); tests using it are
# skipped where the file is missing.
CSV = os.environ.get("POLYLABEL_DEV_CSV", "")
