"""How many rows the operators of a query's plan gave, from Spark's own metrics."""


def most_rows(df):
    """(rows, the most rows that an operator of df's plan gave)."""
    rows, most, left = df.collect(), 0, []
    left.append(df._jdf.queryExecution().executedPlan())
    while left:
        plan = left.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(plan.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            left.append(plan.plan())
            continue
        found = plan.metrics().get("numOutputRows")
        most = max(most, found.get().value() if found.isDefined() else 0)
        left += [plan.children().apply(i) for i in range(plan.children().size())]
    return rows, most


def operators(df):
    """The names of the operators of df's plan, after it has run."""
    df.collect()
    names, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        plan = left.pop()
        names.append(plan.getClass().getSimpleName())
        if names[-1] == "AdaptiveSparkPlanExec":
            left.append(plan.executedPlan())
        elif names[-1].endswith("QueryStageExec"):
            left.append(plan.plan())
        else:
            left += [plan.children().apply(i) for i in range(plan.children().size())]
    return names


def shuffled_rows(spark, run):
    """How many rows all stages of run() wrote for shuffles."""

    def written():
        gateway = spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    run()
    return sum(n for i, n in written().items() if i not in before)
