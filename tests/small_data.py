"""Where the smallest fixture tables lie (a module of its own: ``conftest`` is not a unique module name)."""

SF_SMALL = "/root/testdata/sf0.001"
