"""spark-submit launcher: ``spark-submit --py-files dendrospark.zip run_dendrospark.py linkage ...``
(or ``python -m dendrospark.cli ...`` locally)."""

from dendrospark.cli import main

if __name__ == "__main__":
    main()
