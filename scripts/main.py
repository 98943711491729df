"""Entry for spark-submit, which takes a file and not a module."""

from tidewell.__main__ import main

main()
