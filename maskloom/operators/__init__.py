"""DataFrame operators: masking, policies, detection, generation, dirtying and audits."""
