"""``python -m tidemark COMMAND SF_DIR``: runs a command's queries and shows their results.

``nightly SF_DIR PATH RUN`` runs the night's steps with their results and states under PATH; run again with the same RUN it does what is left.
"""

import sys

from pyspark.sql import SparkSession

from tidemark.plans import catalog, nightly

COMMANDS = {
    "scan": ["tradeability", "location_features", "trigger_features", "regime_label"],
    "search": ["search_generation", "leaderboard"],
    "promote": ["gate", "promotable"],
    "signals": ["signal_reasons"],
    "trades": ["replayed_trades", "paper_trades", "trade_tally"],
    "monitor": ["divergence_detector", "decay_detector", "drawdown_detector", "calibration_detector", "regate"],
    "regime-sanity-check": ["regime_shares"],
    "test-era-score": ["firewall_counts", "regime_rank"],
    "leak-check": ["leakage_invariant", "cpcv_leaks"],
}
COMMANDS |= {"migrate": ["ingested"], "inject-leak-test": ["leak_checkpoint"], "validate": ["validated"], "calibrate": ["calibrate"], "importance": ["permutation_importance", "shap_importance", "importance_by_layer"]}


def _spark() -> SparkSession:
    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str]) -> int:
    if len(args) == 4 and args[0] == "nightly":
        states = nightly.run(_spark(), *args[1:])
        states.orderBy("pos").show(truncate=80)
        return int(not states.where("state <> 'done'").isEmpty())
    if len(args) != 2 or args[0] not in {*COMMANDS, *catalog.QUERIES}:
        print(__doc__, "Commands:", ", ".join(COMMANDS), "or the name of a query.")
        return 2
    spark = _spark()
    for name in COMMANDS.get(args[0], [args[0]]):
        print(name)
        catalog.QUERIES[name](spark, args[1]).show(20, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
