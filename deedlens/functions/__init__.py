"""deedlens.functions"""
