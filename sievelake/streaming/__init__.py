"""Rules on Structured Streaming inputs."""
