"""Column builders. Nothing here touches a DataFrame or runs a job."""
