"""deedlens.operators"""
