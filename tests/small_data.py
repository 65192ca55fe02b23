"""Where the tests' tables lie."""

SMALL = "/root/testdata/sf0.001"
