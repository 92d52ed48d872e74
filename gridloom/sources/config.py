"""Session settings for cloud stores and partition sizes."""

from __future__ import annotations

#: Option names of the three stores -> Hadoop settings.
KEYS = {
    "aws": {"access_key": "spark.hadoop.fs.s3a.access.key", "secret_key": "spark.hadoop.fs.s3a.secret.key", "session_token": "spark.hadoop.fs.s3a.session.token", "endpoint": "spark.hadoop.fs.s3a.endpoint", "region": "spark.hadoop.fs.s3a.endpoint.region"},
    "gs": {"service_account": "spark.hadoop.google.cloud.auth.service.account.json.keyfile", "project": "spark.hadoop.fs.gs.project.id"},
    "azure": {"account": "spark.hadoop.fs.azure.account.name", "key": "spark.hadoop.fs.azure.account.key"},
}


def cloud_settings(**stores: dict[str, str]) -> dict[str, str]:
    """Spark settings for aws=, gs= and azure= options; unknown ones are an error."""
    out = {}
    for store, options in stores.items():
        if store not in KEYS:
            raise ValueError(f"unknown store {store}")
        for k, v in options.items():
            if k not in KEYS[store]:
                raise ValueError(f"unknown option {k} of {store}")
            out[KEYS[store][k]] = v
    return out


def anonymous() -> dict[str, str]:
    return {"spark.hadoop.fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"}


def partition_settings(target_bytes: int = 128 << 20) -> dict[str, str]:
    """Input splits and shuffle partitions of about target_bytes."""
    return {"spark.sql.files.maxPartitionBytes": str(target_bytes), "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_bytes), "spark.sql.adaptive.enabled": "true"}


def builder(settings: dict[str, str]):
    """A session builder with the settings, which executors inherit."""
    from pyspark.sql import SparkSession

    return SparkSession.builder.config(map=settings)
